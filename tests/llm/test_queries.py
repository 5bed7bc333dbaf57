"""The registered queries over whole small tables with planted cases, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from screenlab.llm import queries, secret_scan

from test_corpus import base_matches, brute_hits, roots, vector_links, words

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
RNG = random.Random(12)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "é") for b in ("ra", "ti", "so", "Vu", "7")]
KEY, TOKEN = "AKIA" + "B" * 16, "aB3/" * 10


def prose(n):
    return " ".join(RNG.choices(VOCAB, k=n)) + "."


def near(text, edits):
    w = text.split()
    for _ in range(edits):
        w[RNG.randrange(len(w))] = "edit"
    return " ".join(w)


def planted_documents():
    bench = [(f"b{i}", prose(30)) for i in range(6)] + [("short", "mi so mi"), ("none", "!"), ("null", None)]
    texts = [prose(RNG.randrange(20, 120)) for _ in range(50)]
    texts += [near(t, RNG.randrange(4)) for t in texts[:20] for _ in range(2)] + [texts[3]] * 5 + [None, "", "?!", "one", "one two three four"]
    texts += [f"{prose(5)} {bench[k][1]} {prose(9)}" for k in range(6)] + [bench[0][1] * 3, prose(400) + " MI, so mi"]
    pad = lambda n: "x " * (n // 2)
    texts += [
        f"{KEY} {TOKEN}", f"{KEY}{pad(198)}{TOKEN}", f"{KEY}{pad(204)}{TOKEN}", f"client_id = abcd-1 {pad(100)} {TOKEN} {pad(120)} https://h.example/a", f"https://h.example/a {pad(300)} {KEY} {TOKEN}",
        f"login: somebody {pad(900)} {TOKEN} {pad(100)} password=hunter2222 https://h.example/b", f"{TOKEN}{TOKEN} {pad(10)} {TOKEN}", f"username=jo-hn {'=' * 900} {KEY}", "secret: " + TOKEN * 30 + f" {pad(150)} user_name: abcd",
        f"api_key: 'abcdef' {prose(30)} {'0123456789abcdef' * 2}",
    ]
    return list(enumerate(texts)), bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and their rows."""
    folder, held = str(tmp_path_factory.mktemp("tables")), {}

    def put(name, rows, schema):
        held[name] = rows
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")

    docs, bench = planted_documents()
    put("documents", [(i, t, "en", "hot" if i % 3 else None, len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", bench, "item_id string, text string")
    put("labels", [(i, int(t is not None and len(t) > 30), 0) for i, t in docs if i % 2] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    vs = [(base[i % 6] + rng.standard_normal(16) * rng.choice([0.0, 0.2, 0.3])).astype(np.float32).tolist() for i in range(80)] + [None, [0.0] * 16, [float("nan")] * 16]
    put("embeddings", [(i, v, i % 2 if i % 9 else None) for i, v in enumerate(vs)], "vec_id long, embedding array<float>, label int")
    hosts = ["a.net", "x.EXAMPLE.net", "example.net", "example.com", "b.example.com", "q.org", "net", "anet", "org.", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?y#z", "/de/a", "/fr/", "/fr", "?/fr/", "#/en/")] + [None, "net/", "a://", "x://b.net://c/"]
    html = [f"<html><head><title>t</title><style>p{{}}</style></head><body><h1>{prose(3)}</h1><p class='hidden x'>{prose(9)}<p hidden>{prose(2)}</p><ul><li>{prose(2)}<li>{prose(1)}</ul><table><tr><td>{prose(2)}<td>{prose(1)}</table><script>var {k}<b</script>&amp; &eacute;</body></html>" for k in range(20)]
    html += [None, "", "no tags & text", "<p>unclosed <b>bold", "a<!-- c --><br>b", "<div style='display:none'>x<div>y</div></div>z"]
    put("pages", [(i, urls[i % len(urls)], html[i % len(html)]) for i in range(max(len(urls), len(html)))] + [(0, urls[0], html[0])], "page_id long, url string, html string")
    said = [(c, k, "assistant" if k % 2 else "user", RNG.choice([prose(4), "", None, "<|im_end|>\n", "\\<|"])) for c in range(30) for k in range(RNG.randrange(1, 9))]
    put("conversations", said, "conv_id long, turn long, role string, text string")
    return folder, held


def answered(spark, tables, name, key):
    got = [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, tables[0]).collect()]
    out = defaultdict(list)
    for r in got:
        out[r[key]].append(r)
    return got, out


def test_op1(spark, tables):
    _, got = answered(spark, tables, "op1_chat_format", "conv_id")
    said = defaultdict(list)
    for c, _, role, text in sorted(tables[1]["conversations"]):
        said[c].append((role, text or ""))
    said[-1] = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == set(said)
    for c, turns in said.items():
        (r,) = got[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))


def test_op2(spark, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    got, by = answered(spark, tables, "op2_bpe", "doc_id")
    assert len(got) == len(tables[1]["documents"])
    for i, text, *_ in tables[1]["documents"]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in by[i]] == [(len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))]


def test_op3(spark, tables):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t, *_ in tables[1]["documents"]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    n, own = defaultdict(int), roots(list(sets), links)
    for pair in links:
        for x in pair:
            n[x] += 1
    got, _ = answered(spark, tables, "op3_jaccard_join", "doc_id")
    assert len(links) > 30 and sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(i, own[i], n[i]) for i in sorted(sets)]


def test_op4(spark, tables):
    got, by = answered(spark, tables, "op4_decontaminate", "doc_id")
    assert len(got) == len(tables[1]["documents"]) and sum(r["contaminated"] for r in got) >= 7
    for i, t, *_ in tables[1]["documents"]:
        n, hit, items = brute_hits(t, tables[1]["benchmark"])
        assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in by[i]] == [(n, hit, len(items), sha(",".join(items)), hit > 0 and 20 * hit >= n)]


def test_op5(spark, tables):
    got, by = answered(spark, tables, "op5_shard", "doc_id")
    assert len(got) == len(tables[1]["documents"])
    for i, t, *_ in tables[1]["documents"]:
        data = (t or "").encode()
        assert [(r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in by[i]] == [(len(data) + 1, zlib.crc32(data), "bytes", None)]
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * longest


def test_op6(spark, tables):
    rows = [(*r, None) for r in tables[1]["embeddings"]]
    links = vector_links(rows)
    n, own = defaultdict(int), roots([r[0] for r in rows], links)
    for pair in links:
        for x in pair:
            n[x] += 1
    got, _ = answered(spark, tables, "op6_near_vectors", "vec_id")
    assert len(links) > 30 and sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(i, n[i], own[i], i == own[i]) for i in sorted(own)]


class Visible(HTMLParser):
    """The words of a page that are in no head, script, style or hidden element."""

    def __init__(self):
        super().__init__()
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img", "input"):
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            hides = tag in ("head", "script", "style") or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "")
            self.open.append((tag, hides or (bool(self.open) and self.open[-1][1])))
        self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass
        self.out.append(" ")

    def handle_data(self, data):
        if not self.open or not self.open[-1][1]:
            self.out.append(data)


def test_op7(spark, tables):
    got, by = answered(spark, tables, "op7_html_text", "page_id")
    assert len(got) == len(tables[1]["pages"])
    for i, _, source in tables[1]["pages"]:
        parser = Visible()
        parser.feed(source or "")
        parser.close()
        for r in by[i]:
            assert (r["text"] is None) == (source is None) and [w for w in (r["text"] or "").split() if w != "-"] == "".join(parser.out).split()


def test_op8(spark, tables):
    got, by = answered(spark, tables, "op8_url_filter", "page_id")
    assert len(got) == len(tables[1]["pages"])
    for i, url, _ in tables[1]["pages"]:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert {(r["host"], r["path"], r["rule"], r["verdict"]) for r in by[i] if r["page_id"] == i} == {(host, path, rule, verdict)}


def test_op9(spark, tables):
    got, by = answered(spark, tables, "op9_quality", "doc_id")
    assert sorted(by) == [i for i, *_ in tables[1]["documents"]] and len(got) == len(by)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    same = defaultdict(set)
    for i, t, *_ in tables[1]["documents"]:
        same[t].add(by[i][0]["score"])
    assert all(len(s) == 1 for s in same.values())  # nothing but the text decides


def brute_spans(text, scope=200):
    """Base spans, and the weak parts with complements less than ``scope`` away, pair by pair."""
    base = base_matches(text)
    outside = lambda s, e: all(e <= b[0] or s >= b[2] for b in base)
    weak = [(m.start(1), 3, m.end(1)) for m in secret_scan.WEAK_ID.finditer(text)] + [(m.start(), 5, m.end()) for m in secret_scan.ADDRESS.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in secret_scan.WEAK_SECRET.finditer(text) if all(any(f(c) for c in m[0]) for f in (str.isdigit, str.islower, str.isupper))]
    weak = [w for w in weak if outside(w[0], w[2])]
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
    near = lambda a, b: a[0] < b[2] + scope and b[0] < a[2] + scope
    need = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}
    added = [w for w in weak if need[role[w[1]]] <= {role[o[1]] for o in base + weak if o != w and near(w, o)}]
    return base, sorted(base + added)


def test_op10(spark, tables):
    got, by = answered(spark, tables, "op10_secret_scan", "doc_id")
    named = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert len(got) == len(tables[1]["documents"]) and sum("linked" in r["spans"] for r in got) >= 5
    for i, t, *_ in tables[1]["documents"]:
        base, spans = brute_spans(t or "")
        (r,) = by[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r["base_sha256"] == sha(named(base)) and r["spans"] == named(spans), t
