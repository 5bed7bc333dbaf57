"""Chat formatting, BPE, HTML, URL rules: small cases with known or brute-force results."""

import pytest
from pyspark.sql import functions as F

from screenlab.llm import bpe, chat, html_text, url_rules
from screenlab.llm.queries import tokenizer_path

MESSAGES = "tree long, id string, parent string, role string, text string, score double, extra int"


def formatted(df):
    done = df.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn("turns", chat.read_back(F.col("formatted")))
    return {r["leaf"]: r for r in done.collect()}


def test_best_branches_and_odd_trees(spark):
    rows = [
        (1, "a", None, "user", "q", 1.0, 0), (1, "b", "a", "assistant", "low", 0.1, 0), (1, "c", "a", "assistant", "high", 0.9, 0), (1, "d", "c", "user", None, 0.5, 0),
        (2, "o", "gone", "user", "orphan", 0.0, 0), (3, "s", "s", "user", "own parent", 0.0, 0),
        (4, "x", "y", "user", "cycle", 0.0, 0), (4, "y", "x", "user", "cycle", 0.0, 0),
        (5, "t", None, "user", "twice", 0.0, 0), (5, "t", None, "user", "twice", 0.0, 0), (6, None, None, "user", "no id", 0.0, 0),
    ]
    got = formatted(chat.format_trees(spark.createDataFrame(rows, MESSAGES)))
    assert set(got) == {"d", "o", "s", "t"}
    assert [(t["role"], t["text"]) for t in got["d"]["turns"]] == [("user", "q"), ("assistant", "high"), ("user", "")]
    assert [s["text"] for s in got["d"]["segments"] if s["loss"]] == ["high"] and got["d"]["branch"] == 1
    assert set(formatted(chat.format_trees(spark.createDataFrame(rows, MESSAGES), best=2))) == {"d", "b", "o", "s", "t"}


def brute_paths(rows, best):
    """{leaf: [ids from the root]} of the best branches, by walking up from every leaf."""
    m = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2] is not None, r[2] or "", r[3] or "")):
        m.setdefault(r[1], r)
    up = {i: r[2] if r[2] in m and r[2] != i else None for i, r in m.items()}
    found = {}
    for leaf in set(m) - set(up.values()):
        path = [leaf]
        while (p := up[path[-1]]) and p not in path:
            path.append(p)
        if up[path[-1]] is None:
            found.setdefault(path[-1], []).append((-sum(m[i][5] or 0.0 for i in path) / len(path), leaf, path[::-1]))
    return {leaf: path for all_ in found.values() for _, leaf, path in sorted(all_)[:best]}


@pytest.mark.parametrize("best", [1, 3])
def test_paths_of_random_trees(spark, best):
    import random

    rng, rows = random.Random(best), []
    for t in range(40):
        for k in range(rng.randrange(1, 18)):
            parent = f"{t}-{rng.randrange(k) if t % 3 else k - 1}" if k else rng.choice([None, "gone"])
            rows.append((t, f"{t}-{k}", parent, rng.choice(["user", "assistant"]), f"<|{t} {k}", round(rng.random(), 3), 0))
    rows += [(90, "y1", "y2", "user", "a", 0.0, 0), (90, "y2", "y1", "user", "b", 0.0, 0), (90, "y3", "y1", "user", "c", 0.0, 0)] + rows[5:20]
    messages = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("clash") for c in ("leaf", "branch", "pos", "hash", "root", "segments")})
    got = formatted(chat.format_trees(messages, best=best))
    text = {r[1]: r[4] for r in rows}
    assert {leaf: [t["text"] for t in r["turns"]] for leaf, r in got.items()} == {leaf: [text[i] for i in path] for leaf, path in brute_paths(rows, best).items()}


def test_control_strings_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\\<|\\\\n", "a<", "<|im_end|>\n", "\n\n", "", None, "x" * 20000 + "<|" * 500]
    roles = ["user", "a\\nb", "a\nb", "<|im_start|>", "\\\n", None, "", "assistant", "assistant", "assistant"]
    rows = [(1, str(i), str(i - 1) if i else None, r, t, 0.0, 0) for i, (r, t) in enumerate(zip(roles, texts, strict=True))]
    (got,) = formatted(chat.format_trees(spark.createDataFrame(rows, MESSAGES))).values()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]


def test_long_chain_and_no_rows(spark):
    rows = [(1, str(i), str(i - 1) if i else None, "user", str(i), 0.0, 0) for i in range(70)]
    (got,) = formatted(chat.format_trees(spark.createDataFrame(rows, MESSAGES))).values()
    assert [t["text"] for t in got["turns"]] == [str(i) for i in range(70)]
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).isEmpty()


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello world", "", None, "a<|endoftext|>b <|endoftext|>", "aaaaaaaaa" * 60, " \n\n x  y\t\x1c\x85z", "éÉ 中文 😀 ४२ ²", "I'm we'll 'S", "x" * 5000, "Hello world", " " * 700 + "end"]
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id int, text string, ids int")
    coded = bpe.encode(docs, tokenizer_path())
    got = coded.withColumn("back", bpe.decoder(tokenizer_path())("ids")).orderBy("doc_id").collect()
    for r in got:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["back"] == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.where("false"), tokenizer_path()).isEmpty()
    own = spark.createDataFrame([([15496, None, 10**6, -1],), (None,), ([],)], "ids array<int>").select(bpe.decoder(tokenizer_path())("ids").alias("t"), bpe.digests(tokenizer_path())("ids").alias("d"))
    assert [(r["t"], r["d"]["n_tokens"]) for r in own.collect()] == [(t.decode([15496]), 3), (None, 0), ("", 0)]


def test_bpe_of_long_texts_in_pieces(monkeypatch):
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choices(["a", "é1", " ", "  ", "\n", "'s", "!", "\u3000", "<|endoftext|>", "中", "x9", "'", "l", "e\u0301", "..'", "<|", "7"], k=400))
        assert bpe.encode_texts(tokenizer_path(), [text])[0].tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
        assert max(map(len, bpe.pieces(bpe.vocabulary(tokenizer_path()), text))) < 120


def test_bpe_of_long_words_in_stretches(monkeypatch):
    import random

    from tokenizers import Tokenizer

    rng, t, v = random.Random(6), Tokenizer.from_file(tokenizer_path()), bpe.vocabulary(tokenizer_path())
    made, own = [], bpe.merge_words
    monkeypatch.setattr(bpe, "merge_words", lambda v, raw: made.append(sum(map(len, raw))) or own(v, raw))
    alphabets = ["ab", "a", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "é中文字ж", "the an ing er tion".split()]
    for k in range(18):
        word = "".join(rng.choices(alphabets[k % len(alphabets)], k=3000)) if k % 2 else "".join(rng.choice("ab") * rng.randrange(1, 300) for _ in range(20))
        for most, overlap in ((400, 16), (150, 1), (30, 2)):
            made.clear()
            ids = bpe.merge_long(v, word.encode(), most, overlap)
            assert ids.tolist() == t.encode(word, add_special_tokens=False).ids
            assert len(made) > 1
            if most == 400:
                assert max(made) < 2500  # hardly ever more than a stretch
    monkeypatch.setattr(bpe, "MERGE_BYTES", 300)
    texts = ["a" * 1000 + " bc " + "x1" * 500 + "!" * 800, "\n" * 2000, "<|endoftext|>" + "q" * 400, "", "z" * 299]
    flat, count = bpe.encode_texts(tokenizer_path(), texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert flat.tolist() == sum(want, []) and count.tolist() == list(map(len, want))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<b>a</b> <i>b</i>", "a b"),
        ("<script>x<y</script>a<style>p{}</style>b<!-- c -->", "ab"), ("<div hidden>x</div><p style='display:none'>y</p>z", "z"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>c<td>22</table>", "Name  N\nab    1\nc     22"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("<title>t</title><h1>H</h1>x", "H\n\nx"), ("<p>a</div>b</p>", "ab"), ("a<b", "a"), ("<td>x</td></table>", "x"),
    ],
)
def test_html_layout(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table>Intro<tr><td>a</td>stray<td>b</td></tr></table>", "Intro\nstray\na  b"), ("<table><tr><td>a</td></tr>last</table>end", "last\na\n\nend"),
        ("x<table><form><h2>Head</h2><tr><td>a<tr><td>b</form></table>", "x\n\nHead\na\nb"), ("<table><tr>one<table><tr>two<td>in</table><td>out</table>", "one\n\ntwo\nin\nout"),
        ("<table><caption>cap<td>a</table>", "cap\na"), ("<table><tr><td>a<caption>cap</caption><td>b</table>", "a\ncap\nb"), ("<table> <tr>\n<td>a</td> <td>b</td></table>", "a  b"),
    ],
)
def test_html_text_in_no_cell(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p title="the hidden gem">a</p>', "a"), ('<p class="hidden md:block">a</p>', "a"), ("<p data-hidden=1 class=hidden>a", "a"), ('<b aria-hidden="true">a</b>', "a"),
        ('<p title="style=display:none">a', "a"), ('<p data-style="display:none">a', "a"), ("<p style='background:url(x;display:none)'>a", "a"), ("<p style='--x:\"display:none\"'>a", "a"),
        ("<p hidden=''>a</p>b", "b"), ("<p HIDDEN>a</p>b", "b"), ("<p style='color:red; DISPLAY : none !important; display:block'>a</p>b", "b"), ("<p style=display:none>a</p>b", "b"),
        ("<p hidden style='display:block'>a</p>b", "a\n\nb"), ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"), ("<p style='display&#58;none'>a</p>b", "b"),
        ("<svg><title>t</title><desc>d</desc><style>s{}</style><path d='M0'/><text x=1>a</text><text>b</text></svg>c", "a b c"), ("<div><svg viewBox='0 0 1 1'/>a<p>b</div>c", "a\n\nb\n\nc"),
        ("<div><math/>a<b>b</b></div>", "ab"), ("<svg><title/><text>a</text></svg>b", "a b"), ("<math><mn>1</mn><mo>+</mo><mi>x</mi><annotation>1+x</annotation></math> is", "1 + x is"),
        ("<svg hidden><text>a</text></svg>b", "b"), ("<svg width=10/><text>a</text></svg>b", "a b"), ("<svg><text><![CDATA[a<b>&amp;]]></text></svg>", "a<b>&amp;"),
        ("in: <textarea name=q>x &amp; <b>y</textarea>!", "in: x & <b>y !"), ("<textarea>\na\n  b</textarea>c", "a\n  b\nc"), ("<textarea hidden>a</textarea>b", "b"), ("<xmp><p>a</xmp>b", "<p>a\nb"),
    ],
)
def test_html_what_is_visible(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><th colspan=2>Name<th>N<tr><td>ab<td>c<td>1<tr><td>d<td>efg<td>22</table>", "Name     N\nab  c    1\nd   efg  22"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td>a<td colspan='x'>b<tr><td rowspan=0>cc<td>d<tr><td>e</table>", "a   b\ncc  d\n    e"),
        ("<table><tr><td colspan=3>wide heading<tr><td>a<td>b<td>c</table>", "wide heading\na  b  c"), ("<table><caption>about the table<tr><td>a<td>b</table>", "about the table\na  b"),
        ("<table><tr><td>" + "x" * 300 + "<td>a<tr><td>y<td>b</table>", "x" * 300 + "  a\ny" + " " * 201 + "b"),
        ("Size <select><option>S<option selected>M<optgroup label=x><option>L</select> left", "Size\nS\nM\nL\nleft"), ("<select hidden><option>S</select>a<datalist><option>b</datalist>", "a"),
        ("<table><tr><td>a<table><b>x</b></td></tr><tr><td>y</table>b<td>c</table>", "a  c\n\nx\ny\n\nb"), ("<p>a<b>b</p>c", "ab\n\nc"), ("<div><table><tr><td><i>a</div>b</i></table>c</div>d", "ab\n\nc\nd"),
    ],
)
def test_html_cells_and_choices(source, text):
    assert html_text.render(source) == text


def test_html_work_grows_with_the_page():
    import time

    def took(page):
        began = time.process_time()
        assert html_text.render(page)
        return time.process_time() - began

    for page in (lambda n: "a" + "<span>" * n + "</p>" * n, lambda n: "a" + "<b>" * n + "<li>" * n, lambda n: "<table>" + "<tr><td>a<td rowspan=3>b" * n, lambda n: "<div>" * n + "x</i>" * n):
        took(page(500))
        assert took(page(20_000)) < 40 * took(page(2000)) + 0.2


@pytest.mark.parametrize("depth", [0, 7, 8, 200])
def test_html_blanks_deep_in_cells(depth):
    cell = lambda s: "<table><tr><td>" + "<div>" * depth + s + "</div>" * depth + "</td></tr></table>"
    assert html_text.render(cell("<b>one</b> <i>two</i>")) == "one two" and html_text.render(cell("<pre><b>a</b>  \n <b>b</b></pre>")) == "a\n b"
    assert html_text.render(cell(cell("<b>one</b> <i>two</i>") + "<b>x</b>\n<b>y</b>")) == "one two\n\nx y"
    assert html_text.render("<table><b>one</b> <i>two</i> <tr> <td>c</td> </tr></table>") == "one two\nc"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "<p>x", "u"), (2, "<p>x", "u"), (3, "<div>" * 3000 + "deep", "u")], "page_id int, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(pages).collect() if r["text"] is not None)
    assert got == [(2, "x"), (2, "x"), (3, "deep")] and html_text.extract(pages).count() == 4
    assert html_text.extract(pages.where("false")).isEmpty()


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("a.b", None, "block"), ("com", "", "allow")]
    urls = ["http://x.example.NET/en/1?q", "http://example.net/e", "http://net", "http://a.com/de/", "http://example.com/de/#f", "https://q.org/fr/x", None, "no scheme", "http://xnet/", "http://q.a.b", "http://A.B?x", "http://net/", "http://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got[0] == ("x.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2] == ("net", "", None, "allow")
    assert got[3][2:] == ("com", "allow") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][2] is None and got[9][2] == "a.b" and got[10] == ("a.b", "", "a.b", "block") and got[12][3] == "block"
    none = url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert none.count() == len(urls) and none.where("verdict <> 'block'").isEmpty()
    assert url_rules.judge(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).isEmpty()
