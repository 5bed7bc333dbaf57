"""The pipeline on a small corpus: each stage decides on what the one before kept."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    prose = lambda n=80: " ".join(rng.choices(vocab, k=n)) + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in rng.choices(vocab[:5], k=80))
    texts = {i: prose() if i % 5 else junk() for i in range(200)}
    passage = prose(40)
    texts |= {300: texts[1], 301: texts[1] + " tail", 302: passage, 303: prose() + " password = hunter22", 304: None, 305: "", 306: prose(3000)}
    rows = [(i, t, "en", "s", len(t or ""), "own") for i, t in texts.items()] + [(2, texts[2], "en", "s", 0, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = {i for i in texts if i >= 300 or i % 5} - set(range(304, 306))
    assert set(seen["quality"]) - {304, 305} == kept
    assert set(seen["near_duplicates"]) - {304, 305} == kept - {300, 301}
    assert spark.read.parquet(f"{tmp_path}/near_duplicates").where("doc_id = 2").count() == 1
    assert set(seen["decontamination"]) - {304, 305} == kept - {300, 301, 302}
    assert seen["secrets"][303]["text"].endswith("[assign]") and seen["secrets"][303]["n_chars"] == len(seen["secrets"][303]["text"])
    assert seen["secrets"][1]["text"] == texts[1] and seen["secrets"][1]["text_hash"] == "own"
    assert set(seen["encoding"]) == set(seen["secrets"]) and seen["encoding"][1]["n_tokens"] == len(seen["encoding"][1]["ids"])


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(rng.choices([f"word{i}" for i in range(300)], k=80)) for _ in range(4))
    rows = [(1, a), (5, a + " tail"), (5, b), (2, c), (2, c + " tail"), (1, d), (7, d + " tail"), (7, d + " tail"), (9, ""), (9, ""), (9, None), (None, a), (1, a)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert [x for x in got if x[0] is None] == [(None, a)] and {(1, a), (5, b), (1, d)} <= set(got)
    assert len([x for x in got if x[0] == 2]) == 1 and sorted(x[0] for x in got if x[0]) == [1, 1, 2, 5, 9, 9]


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    secret = "token = abcdefgh"
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, secret, "en", "s", 16), (2, "other words " * 9, "en", "s", 5), (2, secret, "en", "s", 16), (3, "y" * 300_000, None, None, 1)]
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = sorted(map(tuple, out.collect()), key=repr)
            if name == "encoding":
                assert len(got) == len(rows) and {r[1] for r in got if r[0] == 1} <= {0}
            elif name == "secrets":
                assert len(got) == len(rows) and sum(r[1] == "[assign]" for r in got) == (2 if rows else 0)
            elif name == "near_duplicates":
                assert got == sorted(set(rows), key=repr)
            else:
                assert len(got) in (0, len(rows)) and (name == "quality" or got == sorted(rows, key=repr))
