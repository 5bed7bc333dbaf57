"""Joins, searches, sharding, quality and secrets against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from screenlab.llm import common, decontaminate, jaccard, quality, secret_scan, sharding, vectors
from screenlab.llm.words import hash_string, hash_words, text_buffer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def roots(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_word_hashes():
    texts = ["Éa B2,c", None, "", "x" * 3, "É Ⅱ a", "a", "b"]
    data, offsets = text_buffer(pa.array(texts))
    h, first = hash_words(data, offsets)
    assert list(np.diff(first)) == [len(words(t)) for t in texts]
    assert (h == hash_string([w for t in texts for w in words(t)])).all()


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_word_hashes_in_pieces(monkeypatch, block):
    rng = random.Random(block)
    texts = ["".join(rng.choices("aB1 é.Ⅱ", k=rng.randrange(0, 40))) for _ in range(60)] + ["", "x" * 500, None, "", " " * 90, "y"]
    data, offsets = text_buffer(pa.array(texts))
    want = hash_string([w for t in texts for w in words(t)])
    monkeypatch.setattr("screenlab.llm.words.BLOCK", block)
    h, first = hash_words(data, offsets)
    assert (h == want).all() and list(np.diff(first)) == [len(words(t)) for t in texts]


def near_copies(rng, n=60):
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(rng.randrange(40)) for _ in range(n)]
    return base


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 6)  # buckets go in pairs of chunks
    rng, texts = random.Random(2), []
    for _ in range(12):
        base = near_copies(rng)
        for _ in range(rng.randrange(1, 14)):
            w = base.copy()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(999))
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper() + "!", None, "", "?!", "one two", "One, two!", "a b c d e", "x " * 4000]
    # Exactly at the threshold: 8 of 10 shingles.
    texts += [" ".join(f"t{i}" for i in range(13)), " ".join(f"t{i}" for i in range(12))]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(None, texts[0], "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    n = defaultdict(int)
    for pair in links:
        for x in pair:
            n[x] += 1
    own = roots(list(sets), links)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    assert [(r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None and (r["class_id"], r["n_links"]) != (own[r["doc_id"]], n[r["doc_id"]])] == []
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None] == [(None, 0)]
    assert jaccard.join(docs.where("false")).isEmpty()
    for chunk in (6, 2):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        same = jaccard.join(docs, parts_of=True, all_links=False).collect()  # what is linked, without how often
        assert [(r["doc_id"], r["class_id"], r["n_links"] > 0) for r in same if r["doc_id"] is not None and (r["class_id"], r["n_links"] > 0) != (own[r["doc_id"]], n[r["doc_id"]] > 0)] == []
        assert len(same) == len(rows)
    assert jaccard.join(docs.where("false"), all_links=False).isEmpty()


def brute_hits(text, bench, n=13):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        k = min(n, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                items.add(str(item))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize(("limit", "shard"), [(16_000_000, 1_000_000), (16_000_000, 40), (300, 1_000_000)])
def test_decontamination(spark, monkeypatch, limit, shard):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", limit)  # the small one takes the benchmark in blocks
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.randrange(10, 25)))) for i in range(12)] + [(50, "The End"), (51, None), (52, "!"), (53, ""), (50, "the end"), (60, "w1 w1 w1")]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 60))) for _ in range(30)]
    texts += [f"{a} {t.upper()}, {b}" for (_, t), a, b in zip(bench[:12], texts, texts[1:], strict=False)] + [None, "", "the END the end", "w1 " * 50, texts[3], texts[3], bench[0][1] + " x " + bench[0][1]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, items int")
    found = decontaminate.search(docs, spark.createDataFrame(bench, "item_id int, text string"), shard_words=shard).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], bench), r
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    if limit > 300:
        empty = spark.createDataFrame([], "item_id int, text string")
        assert decontaminate.search(docs, empty).where("n_hit > 0").isEmpty() and decontaminate.search(docs.where("false"), empty).isEmpty()


def test_equal_hashes_of_different_words(monkeypatch):
    one, other = hash_string(["w3", "zz"])

    def weak(data, offsets):
        h, first = hash_words(data, offsets)
        return np.where(h == other, one, h), first

    monkeypatch.setattr(decontaminate, "hash_words", weak)
    bench = [("a", " ".join(f"w{i}" for i in range(20))), ("b", "w3 w4"), ("c", "w3 w3")]
    texts = ["w1 w2 zz w4 w5", "x W3 w4 zz zz", " ".join(f"w{i}" for i in range(16)), " ".join(f"w{i}" for i in range(16)).replace("w3", "zz"), "w3 w3 w4"]
    p, column = decontaminate.phrases(bench, 13), pa.array(texts)
    words, *runs = decontaminate.known(p, column)
    hits, _, items = decontaminate.find(p, column, *runs)
    assert [(int(a), int(b), c) for a, b, c in zip(words, hits, items, strict=True)] == [brute_hits(t, bench) for t in texts]
    # Both words in the benchmark: each has its own number.
    bench += [("d", "zz w4"), ("e", "w9 zz w9"), ("f", " ".join(f"w{i}" for i in range(16)).replace("w3", "zz"))]
    p = decontaminate.phrases(bench, 13)
    assert sorted(p.twins) == ["w3", "zz"] and [p.names[n - 1] for n in p.stream[20:24].tolist()] == ["w3", "w4", "w3", "w3"]
    texts += ["w9 zz w9 w9 W3 w9", "ZZ w4", "zz zz w3 w3 w4 w5 zz w4"]
    words, *runs = decontaminate.known(p, pa.array(texts))
    for shard in (1_000_000, 5):
        hits, _, items = decontaminate.find(p, pa.array(texts), *runs, shard)
        assert [(int(a), int(b), c) for a, b, c in zip(words, hits, items, strict=True)] == [brute_hits(t, bench) for t in texts]


def test_a_benchmark_of_colliding_words(spark):
    """Words made to collide: the polynomial hash of these two is equal whatever its odd multiplier."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(set(hash_string([one, other]).tolist())) == 1
    bench = [("a", f"x {one} y"), ("b", f"{other} z"), ("c", f"{one} {other}")]
    texts = [f"w x {one} y w", f"x {other} y", f"{other.upper()} z {one} z", f"{one} {other} {one}", "x y z", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.search(docs, spark.createDataFrame(bench, "item_id string, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], bench)


def test_shards_go_on_into_the_next(monkeypatch):
    made, own = [], decontaminate.Index
    monkeypatch.setattr(decontaminate, "Index", lambda s, most: made.append(len(s)) or own(s, most))
    rng = random.Random(8)
    bench = [(str(i), " ".join(rng.choices("abcdef", k=15))) for i in range(5)]
    texts = [" ".join(rng.choices("abcdef", k=20)) + " " + bench[i % 5][1] + " " + " ".join(rng.choices("abcdef", k=20)) for i in range(8)]
    p = decontaminate.phrases(bench, 13)
    words, *runs = decontaminate.known(p, pa.array(texts))
    hits, _, items = decontaminate.find(p, pa.array(texts), *runs, 40)
    assert len(made) > 5  # several shards, most windows of which begin in one and end in another
    assert [(int(a), int(b), c) for a, b, c in zip(words, hits, items, strict=True)] == [brute_hits(t, bench) for t in texts]


def test_features_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "C1", "é,", "dd\n"], k=k)) for k in (0, 1, 2, 3, 50, 400)]
    want = quality.features(pa.array(texts))
    monkeypatch.setattr(quality, "BLOCK", 64)
    monkeypatch.setattr("screenlab.llm.words.BLOCK", 64)
    assert np.allclose(np.concatenate([quality.features(pa.array([t])) for t in texts]), want)


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, "hot copy " * 9 if i % 3 == 0 else "x" * rng.randrange(300), 0) for i in range(1500)] + [(None, None, 0), (7, "x", 0), (7, "x", 0), (9, "long" * 900, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(docs).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    by = got.groupby("shard")
    assert set(by.groups) == set(range(8))
    assert (by["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    mean = got["size"].sum() / 8
    assert (by["size"].sum() - mean).abs().max() <= 0.05 * mean + 3601
    small = got[got["size"] < 80].groupby("text_crc32")["shard"].nunique()
    assert (small == 1).mean() > 0.95  # equal texts stay together but for the hot ones
    assert sharding.shard(docs.where("false")).isEmpty()
    again = sharding.shard(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(repr, again[key].values.tolist())) == sorted(map(repr, got[key].values.tolist()))
    named = sharding.shard(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert sum(r["n"] for r in named) == len(rows) and all(r["top"] == r["n"] - 1 for r in named)


def vector_links(rows, threshold=0.93):
    ok = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for i, v, l, _ in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {r[0]: r[2] for r in rows}
    return [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]


@pytest.mark.parametrize(("chunk", "cost", "kind"), [(4096, 20_000, "long"), (16, 20_000, "long"), (16, 0, "string"), (4, 0, "long")])
def test_vector_links(spark, chunk, cost, kind):
    """In one task, in pairs of chunks, in cells, in chunks of cells."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 24)) * ([4.0] * 3 + [1.0] * 21 if not cost else 1.0)
    vs = [(base[i % 12] + rng.standard_normal(24) * rng.choice([0.0, 0.15, 0.25, 0.3])).tolist() for i in range(150)]
    # Exactly at the share of every block, and beside the threshold on either side.
    turn, step = vectors.rotation(24), np.tile([1.0] + [0.0] * 7, 3)
    for c in (0.93 + 1e-12, 0.93 + 1e-7, 0.93 - 1e-7):
        x = np.tile([0.0, 1.0] + [0.0] * 6, 3) / np.sqrt(3)
        vs += [(turn @ x).tolist(), (turn @ (c * x + np.sqrt(1 - c * c) * step / np.sqrt(3))).tolist()] * 2
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [-0.0, 1.0], [0.0, 3.0]]
    rows = [(i, v, i % 2 if i % 11 else None, "n") for i, v in enumerate(vs + odd + [vs[0], [1e200 * x for x in vs[2]]])]
    name = (lambda i: f"{i:04d}") if kind == "string" else (lambda i: i)
    rows = [(name(i), v, l if l is None else name(l), n) for i, v, l, n in rows]
    table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label {kind}, n string")
    links = vector_links(rows)
    n = defaultdict(int)
    for pair in links:
        for x in pair:
            n[x] += 1
    own = roots([r[0] for r in rows], links)
    got = vectors.near_duplicates(table, chunk=chunk, row_cost=cost).collect()
    packed = table.where("embedding is not null and size(embedding) = 24 and label is not null and not exists(embedding, x -> x is null)")
    classes = packed.select("label", F.udf(lambda v: np.array(v).tobytes(), "binary")("embedding").alias("v"), F.lit(24).alias("dim"))
    cells = {r["coordinates"] > 0 for r in vectors.layout(classes, np.dtype("float64"), 0.93, 8, chunk, cost).collect()}
    assert cells == {cost == 0}  # what is named above has happened
    assert len(got) == len(rows) and len(links) > 100
    assert [r for r in got if (r["n_links"], r["component_id"]) != (n[r["vec_id"]], own[r["vec_id"]])] == []
    assert vectors.near_duplicates(table.where("false")).isEmpty()


def test_cells_where_they_pay():
    rng = np.random.default_rng(3)
    even = vectors.units(rng.standard_normal((500, 64)))
    uneven = vectors.units(rng.standard_normal((500, 64)) * np.tile([9.0] + [1.0] * 7, 8))
    for x in (even, uneven):
        assert vectors.cheapest(x, 5000, 8, 0.93) == 0 and vectors.cheapest(x, 10_000_000, 8, 0.93) > 0


def test_bands_spare_comparisons():
    rng = np.random.default_rng(4)
    x = vectors.units(rng.standard_normal((2000, 64)))
    blocks, budgets = vectors.subspaces(64, 8, 0.93)
    met = [{(min(p), max(p)) for i, j in vectors.meet(x, np.arange(2000), None, b, c) for p in zip(i.tolist(), j.tolist(), strict=True)} for b, c in zip(blocks, budgets, strict=True)]
    assert sum(map(len, met)) < 0.01 * 2000 * 1999 / 2  # all that is left to verify
    for b, c, pairs in zip(blocks, budgets, met, strict=True):
        p, q = np.triu_indices(2000, 1)
        near = vectors.gaps(x, p, q, b) <= c
        assert pairs == set(zip(p[near].tolist(), q[near].tolist(), strict=True))


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices("the and of to in is water house over with".split(), k=60)) + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in rng.choices("buy now free win cash".split(), k=60))
    rows = [(i, good() if i % 4 else junk(), "en") for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "en"), (902, good() * 200, "en"), (1, rows[1][1], "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, rows=200)
    got = quality.scored(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and all((r["score"] >= quality.CUT) == (r["doc_id"] % 4 > 0) for r in held)
    again = quality.learn(docs.union(docs).union(docs.where("doc_id = 1").withColumn("text", F.lit("zz"))), labels, rows=200)
    assert np.isfinite(again["w"]).all() and quality.learn(docs.union(docs), labels, rows=200)["cut"] == model["cut"]
    none = quality.learn(docs, labels.where("false"))
    assert quality.scored(docs.where("false"), none).isEmpty() and quality.scored(docs, none).where("score is null").isEmpty()


def base_matches(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark):
    key, token = "AKIA" + "B" * 16, "aB3" * 12
    texts = [
        None, "", "nothing here", f"password = hunter22 {key}", "secret: token: abcdef", "TOKEN='abc'", "é" * 30 + "f" * 30, f"{key} then {token} at https://x.example/v1",
        f"only {token}", f"{token}" + " " * 500 + key, "username: somebody " + token, "https://x.example/v1", "x" * 50000 + " api_key=abcdefg", "a" * 10 + "f" * 14, "AKIAAKIA" + "1" * 12,
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[3], 1)], "doc_id long, text string, base int")
    found = secret_scan.scan(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        t = texts[3 if r["doc_id"] is None else r["doc_id"]] or ""
        assert sorted((s["start"], s["kind"], s["end"]) for s in r["base"]) == base_matches(t)
        assert [s for s in r["spans"] if s["kind"] < 3] == sorted(r["base"], key=lambda s: (s["start"], s["kind"]))
    added = {r["doc_id"]: sorted(s["kind"] for s in r["spans"] if s["kind"] >= 3) for r in found}
    assert added[7] == [secret_scan.SECRET, secret_scan.ENDPOINT] and added[8] == [] and added[9] == [] and added[10] == [secret_scan.ID, secret_scan.SECRET] and added[11] == []
    assert secret_scan.scan(docs.where("false")).isEmpty()
    spans = [{"start": 2, "end": 5, "kind": 0}, {"start": 4, "end": 7, "kind": 2}, {"start": 8, "end": 9, "kind": 1}]
    assert secret_scan.redacted("0123456789", spans) == "01[assign]7[access]9" and secret_scan.redacted(None, spans) is None


def test_secrets_after_equals_signs(spark):
    token, padded = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "aB3" * 12 + "=="
    pairs = [
        ("aws_access_key_id=AKIA" + "B" * 16 + "\naws_secret_access_key=", token, "\n"), ("client_id=my-client client_secret_key=", token, "&x=1"),
        ("export AWS_ACCESS_KEY_ID=AKIA" + "B" * 16 + ";X=", padded, ";"), ("login=somebody k=", padded, token),
    ]
    texts = ["".join(p) for p in pairs] + ["aws_secret_access_key=" + token]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    for i, (before, secret, _) in enumerate(pairs):
        assert (secret_scan.SECRET, len(before), len(before) + len(secret)) in [tuple(s) for s in found[i]["spans"]]
    assert len([s for s in found[3]["spans"] if s["kind"] == secret_scan.SECRET]) == 2 and found[4]["spans"] == []
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, docs, "").collect()}
    assert masked[0] == "aws_access_key_id=[access]\naws_secret_access_key=[linked_secret]\n"
    assert masked[1] == "client_id=[linked_id] client_secret_key=[linked_secret]&x=1" and masked[4] == texts[4]


def test_components_of_stars_and_chains(spark):
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(4000, 4070)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)] + [(7, 7), (4070, 3999)]
    ids = {x for e in edges if e[0] != e[1] for x in e}
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == roots(sorted(ids), edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_join_of_frequent_keys(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("many"), F.max("id").alias("top"))
    got = common.join_frequent(rows, table, ["k"], "many", 4000)
    assert got.count() == 4000 and got.where("k = 1 and top = 3998").count() == 2666 and got.columns == ["k", "id", "top"]


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, [("a", "b" * 500)], None)], "s string, l array<struct<a:string,b:string>>, d double")
    hinted = lambda most: "broadcast" in common.bounded(rows, most).join(rows, "s")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert hinted(2000) and not hinted(1500) and common.bounded(rows.where("false"), 0).count() == 0


def test_unrelated_long_texts_are_pruned():
    rng, vocab = np.random.default_rng(4), np.array([f"w{i}" for i in range(5000)])
    own = [rng.choice(vocab, 2000).tolist() for _ in range(40)]
    near = [w[:1000] + ["x"] + w[1001:] for w in own[:10]]
    mh = np.concatenate([jaccard.compared(jaccard.minhash(s, begins)) for _, s, begins in jaccard.sets_of(pa.array([" ".join(w) for w in own + near]), 5)])
    p, q = np.triu_indices(50, 1)
    first = (mh[p, : jaccard.STEP] == mh[q, : jaccard.STEP]).sum(1) >= jaccard.least_matches(0.8)[jaccard.STEP]
    assert list(zip(p[first].tolist(), q[first].tolist(), strict=True)) == [(i, 40 + i) for i in range(10)]
    assert [x.tolist() for x in jaccard.pruned(mh, p, q, 0.8)] == [list(range(10)), list(range(40, 50))]
