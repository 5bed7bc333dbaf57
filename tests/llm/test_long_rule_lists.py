"""URL rules of very many shapes, against a loop over the rules."""

import random
import time

from screenlab.llm import url_rules


def test_ten_thousand_rules(spark):
    rng = random.Random(8)
    words = ["a", "bb", "ccc", "net", "org", "x1"]
    host = lambda: ".".join(rng.choices(words, k=rng.randrange(1, 9)))
    path = lambda most: "/" + "".join(rng.choices("ab/", k=rng.randrange(most)))
    rules = [(host(), path(5) + "z" * rng.randrange(400), rng.choice(["allow", "block"])) for _ in range(9_000)] + [(host(), path(3), rng.choice(["allow", "block"])) for _ in range(1_000)]
    rules += [("NET", None, "block"), (None, "/", "block"), ("org", "/", None), rules[0]]
    assert len({(h.count("."), len(p or "")) for h, p, _ in rules if h}) > 2_500
    pages = [(k, f"http://{host()}{path(6)}?q") for k in range(300)] + [(k, f"http://{rules[k][0]}{rules[k][1]}zz#f") for k in range(100)] + [(900, None), (901, "no scheme"), (902, "http:///x"), (900, None)]
    began = time.time()
    got = url_rules.judge(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 30
    want = {}
    usable = {(h.lower(), p or "", v) for h, p, v in rules if h and v}
    for k, url in pages:
        rest = (url or "").partition("://")[2]
        h = rest.partition("#")[0].partition("?")[0].partition("/")[0]
        p = rest.partition("#")[0].partition("?")[0][len(h) :]
        fits = [(len(r + q), len(r), v == "block", r + q, v) for r, q, v in usable if h and (h == r or h.endswith("." + r)) and p.startswith(q)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        want[k] = (h, p, best[3], best[4])
    rows = got.collect()
    assert len(rows) == len(pages) and {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == want
    assert sum(r["rule"] is not None for r in rows) > 100
