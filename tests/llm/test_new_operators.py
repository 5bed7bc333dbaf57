"""Resampling, collocations and repeated strings against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from screenlab.llm import collocations, importance, repeats, runs
from screenlab.llm.suffixes import suffix_orders

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
DOCS = "doc_id long, text string, lang string, score string, row int, mask string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "clash", 7, "x") for i, t, lang in rows], DOCS).repartition(parts)


def test_suffix_orders_equal_sorting():
    rng = np.random.default_rng(5)
    for _ in range(150):
        lanes = [rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)) for _ in range(rng.integers(1, 6))]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lanes])))
        order = suffix_orders(np.concatenate(lanes), bounds)
        for i, x in enumerate(lanes):
            assert list(order[bounds[i] : bounds[i + 1]] - bounds[i]) == sorted(range(len(x)), key=lambda j: list(x[j:]))
    assert len(suffix_orders(np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0


def brute_resample(docs, bench, percent, max_n, buckets, min_words):
    def feats(t):
        w = WORDS.findall(lower(t or ""))
        return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in feats(x)[0]) for texts in ([d[1] for d in docs], bench))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b)))
    rows = []
    for i, text, _ in docs:
        f, n = feats(text)
        weight = sum(gain(place(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    best = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    count = percent * len(best) // 100
    out = Counter((*r[:4], k + 1 if k < count else None) for k, r in enumerate(best))
    return out + Counter((*r[:4], None) for r in rows if r[4] < min_words)


@pytest.mark.parametrize("max_n,percent", [(1, 10), (3, 37), (1, 100), (2, 0)])
def test_resample_equals_brute_force(spark, max_n, percent):
    rng = random.Random(max_n)
    vocab = [f"W{a}é{b}" for a in "abcdef" for b in "xyz"] + ["MiX", "9"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 60))), "en") for i in range(300)]
    docs += [(7, docs[7][1], "en")] * 90 + [(8, "another text of eight", "en")] * 2 + [(None, " ".join(vocab[:9]), None), (None, None, "fr"), (900, None, None), (901, "", "en"), (902, "?!", "en"), (903, "long " * 3000 + "x" * 5000, "en")]
    bench = [" ".join(rng.choices(vocab[:6], k=30)) for _ in range(5)] + [None, ""]
    target = spark.createDataFrame([(b, 1) for b in bench], "text string, doc_id int")
    got = importance.resample(table(spark, docs), target, percent, max_n, 50, 2024, 5)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(docs, bench, percent, max_n, 50, 5)


def test_resample_of_empty_tables(spark):
    none = table(spark, [])
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0
    docs = [(i, "a b c " * 9, "en") for i in range(40)]
    assert Counter(tuple(r) for r in importance.resample(table(spark, docs), target).collect()) == brute_resample(docs, [], 10, 1, 10_000, 20)


def test_tournament_merges_chunks_of_runs(spark):
    """Many runs, chunks and ranges: ranks are those of one sort."""
    rows = spark.range(30_000, numPartitions=13).selectExpr("pmod(xxhash64(id), 9000) as doc_id", "20L as n_words", "id % 3 as n_features", "0L as weight", "pmod(xxhash64(id, 5), 400) as score")
    got = [tuple(r) for r in importance.draw(rows, 90, 20).where("rank is not null").orderBy("rank").collect()]
    want = sorted(((r.doc_id, r.n_features, 0, r.score) for r in rows.collect()), key=lambda r: (-r[3], r[0], r[1]))[: 27_000]
    assert [r[:4] for r in got] == want and [r[4] for r in got] == list(range(1, 27_001))


def test_words_and_features_do_not_depend_on_pieces():
    text = ("Ab,c d. " * 50 + "é" * 40 + " x y " + "long" * 30 + " z\n") * 3
    kinds = collocations._kinds()
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 100, len(text.encode())])
    def found(block):
        out = Counter()
        for low, starts, ends, of, stretch, carried in runs.word_pieces(data, offsets, kinds, 2, block):
            for n in (1, 2, 3):
                for i in range(len(starts) - n + 1):
                    if i + n > carried and stretch[i] == stretch[i + n - 1]:
                        out[int(of[i]), tuple(low[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n]))] += 1
        return out
    assert found(1 << 19) == found(7) == found(64) == found(300)


def brute_phrases(docs, max_n, least, absorb, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= absorb * a and inside(p, q) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("max_n,least,top", [(3, 10, 2000), (4, 3, 25), (2, 2, 5)])
def test_phrases_equal_brute_force(spark, max_n, least, top):
    rng = random.Random(max_n)
    vocab = ["the", "of", "New", "york", "City", "é", "a\x00b", "x-y", "ß", "𝄞"]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", ":"]) for _ in range(rng.randrange(60)))
    docs = [(i, text(), rng.choice(["en", "fr", "en", None, "und"])) for i in range(120)] + [(1, "new york city " * 40, "en")] * 3 + [(2, None, "de"), (3, "", None), (None, "...", "xx"), (4, "w " * 5000, "en")]
    got = collocations.mine(table(spark, docs), max_n, least, 50, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, max_n, least, 50, top)


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(table(spark, [])).count() == 0


def brute_repeats(docs, width):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, _ in docs]
    for i, b in texts:
        for k in range(len(b) - width + 1) if i is not None else ():
            first[b[k : k + width]] = min(i, first.get(b[k : k + width], i))
    out = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1) if i is not None else ():
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = tuple((m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone)))
        out[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


def repeated_docs():
    rng = random.Random(13)
    words = lambda k: " ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(k))
    passage, line = words(30), "all rights reserved " * 4
    docs = []
    for i in range(90):
        parts = [words(rng.randrange(1, 40))]
        if i % 2:
            parts.append(passage[rng.randrange(40) :][: rng.randrange(30, 120)])
        if i % 3 == 0:
            parts.append(line)
        rng.shuffle(parts)
        docs.append((i - 5, words(rng.randrange(4)).join(parts), "en"))
    docs += [(200 + k, docs[k % 9][1], None) for k in range(30)]  # whole copies
    docs += [(300 + k, docs[1][1][:k] + "#" + docs[1][1][k:], "en") for k in range(0, 60, 2)]  # near copies
    docs += [(7, docs[3][1], "en"), (7, docs[12][1], "en"), (7, docs[12][1], "en"), (None, passage, None), (None, None, "en"), (400, None, "en"), (401, "", "en"), (402, "x" * 49, "en"), (403, "x" * 49, "en"), (404, "y" * 3000, "en"), (405, "y" * 200 + "z", "en"), (406, "\0" * 120, "en"), (407, "\0" * 120 + passage, "en")]
    return docs


@pytest.mark.parametrize("group_rows,group_parts", [(5000, 31), (5000, 2), (8, 31), (3, 3)])
def test_repeats_equal_brute_force(spark, group_rows, group_parts):
    """Groups sorted whole, cut by longer grams, and cut into strings at once: the last two by parameters that reach the workers."""
    docs = repeated_docs()
    got = repeats.remove(table(spark, docs), 50, group_rows, group_parts)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect())
    assert found == brute_repeats(docs, 50)


def test_groups_are_cut_where_the_parameters_say():
    """Seven different stretches of one gram: sorted with a limit of seven, left for the next gram with six."""
    import pyarrow as pa

    contents = [b"a" * 40 + bytes([65 + k]) + b"common gram stands here" + b"b" * 40 for k in range(7)]
    rows = pa.table({"gram": np.zeros(7, np.int64), "name": np.arange(7), "content": contents, "doc_id": np.arange(7), "root": np.arange(7), "shift": np.zeros(7, np.int32)})
    replies, left = repeats.sorted_out(rows, 50, 7)
    assert not left.num_rows and sorted(replies.column("doc_id").to_pylist()) == [1, 2, 3, 4, 5, 6]
    replies, left = repeats.sorted_out(rows, 50, 6)
    assert left.num_rows == 7 and not replies.num_rows


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove(table(spark, [])).count() == 0


def test_a_large_part_is_sorted_in_bounded_memory():
    """4 MB of stretches in groups of three, which took some 300 MB to sort at once."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 20_000
    words = rng.integers(97, 123, (n, 90), dtype=np.uint8)
    contents = [w[a : a + 70].tobytes() for w in words for a in (0, 10, 20)]
    rows = pa.table({"gram": np.repeat(np.arange(n), 3), "name": np.arange(3 * n), "content": contents, "doc_id": np.tile(np.arange(3), n), "root": np.arange(3 * n), "shift": np.zeros(3 * n, np.int32)})
    tracemalloc.start()
    try:
        replies, left = repeats.sorted_out(rows, 50, 31)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    masks = dict(zip(replies.column("root").to_pylist(), replies.column("mask").to_pylist(), strict=True))
    assert not left.num_rows and masks == {3 * k + i: (1 << 11) - 1 for k in range(n) for i in (1, 2)}
    assert peak < 150e6
