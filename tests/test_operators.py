"""Pairing, picks, aggregates, manifests and splits on small tables."""

import json
import random
import xml.etree.ElementTree
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.functions import imaging
from screenlab.operators import dataset, metrics, rank, relate
from screenlab.plans import evaluate, synth
from screenlab.sources import readers, schema, sinks
from screenlab.streaming import jobs


def test_pairing(spark, tmp_path):
    for name, entries in (("test", ["d/A.PNG", "b.jpg", ".x.png", "d/", "n.txt", "a.jpg"]), ("ref", ["a.jpg", "c.png"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for k, e in enumerate(entries):
                z.writestr(e, imaging.to_png(np.full((2, 3), k, np.uint8)))
            z.writestr("cut.png", imaging.to_png(np.zeros((9, 9), np.uint8))[:-20])
            z.writestr("words.jpg", b"no image")
    sides = [relate.last_wins(readers.archive_entries(spark, f"{tmp_path}/{n}.zip"), "stem", "ordinal") for n in ("test", "ref")]
    got = relate.pair(*sides, "stem").orderBy("stem").collect()
    assert [(r["stem"], r["pair_class"]) for r in got] == [("a", "matched"), ("b", "only_test"), ("c", "only_reference")]
    assert got[0]["test"]["display_name"] == "a.jpg" and got[0]["test"]["place"] == 0 and got[0]["test"]["content"] == imaging.to_png(np.full((2, 3), 5, np.uint8))


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    truth = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "k string, t string, ord int")
    assert {r["k"]: r["t"] for r in relate.attach(rows, truth, "k", "t").collect()} == {"a": "new", "b": ""}
    there = spark.createDataFrame([("y/a",), ("x/b",), ("y/b",)], "path string")
    got = relate.resolve(rows, there, [F.concat(F.lit("x/"), "k"), F.concat(F.lit("y/"), "k")])
    assert {r["k"]: r["path"] for r in got.collect()} == {"a": "y/a", "b": "x/b"}
    assert relate.assert_present(rows, truth.union(spark.createDataFrame([("b", "", 0)], truth.schema)), "k").count() == 2
    with pytest.raises(Exception, match="missing: b"):
        relate.assert_present(rows, truth, "k").collect()


def test_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), float(rng.randrange(100)), rng.random() < 0.3) for i in range(120)]
    got = relate.near_in_group(spark.createDataFrame(rows, "id int, g int, y double, ok boolean"), "g", "y", 2.0, F.col("ok")).collect()
    for r in got:
        assert r["near"] == any(o[0] != r["id"] and o[1] == r["g"] and o[3] and abs(o[2] - r["y"]) <= 2 for o in rows)


def test_quantiles_and_picks(spark):
    ten = spark.createDataFrame([(float(i), i) for i in range(1, 11)], "v double, id int")
    r = metrics.nearest_ranks(ten, "v").first()
    assert (r["p50"], r["p90"], r["p95"], r["max"], r["n"]) == (6, 10, 10, 10, 10)
    ties = spark.createDataFrame([(x,) for x in [1.0] * 7 + [2.0] * 3 + [None]], "v double")
    assert [metrics.nearest_ranks(ties, "v").first()[k] for k in ("p50", "p90", "n")] == [1, 2, 10]
    assert metrics.nearest_ranks(ties.where("false"), "v").first()["mean"] == 0.0
    four = spark.createDataFrame([("g", v, i) for i, v in enumerate((4.0, 1.0, 3.0, 2.0))], "g string, v double, id int")
    assert rank.upper_median(four, "g", "v", "id").first()["v"] == 3.0 and rank.best_per_group(four, "g", "v", "id").first()["v"] == 1.0
    assert [r["id"] for r in rank.extremes(four, 1, "v", "id").collect()] == [1, 0] and rank.top(four, 0, "id").count() == 4
    assert [r["row"] for r in rank.numbered(ten.withColumn("n", F.lit("x")), "n", "id").orderBy("id").collect()] == list(range(1, 11))
    shown = spark.createDataFrame([("b", 0.1, "PASS", 0), ("A", 0.9, "FAIL", 1)], "filename string, cer double, verdict string, ord int")
    assert [r["filename"] for r in rank.view(shown, [], "name").collect()] == ["A", "b"] and rank.view(shown, ["PASS"]).count() == 1


def test_numbers_keep_wide_rows(spark):
    n = 200_000
    rows = spark.range(0, n, 1, 8).select(F.sha1(F.col("id").cast("string")).alias("filename"), F.col("id").alias("stem"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
    got = rank.numbered(rows, "filename", "stem").agg(F.count("*"), F.count_distinct("row"), F.min("row"), F.max("row"), F.count_if(F.length("wide") == 256)).first()
    assert tuple(got) == (n, n, 1, n, n)
    order = rank.numbered(rows, "filename", "stem").orderBy("row").select("stem").limit(1000).collect()
    assert [r["stem"] for r in order] == [r["stem"] for r in rows.orderBy("filename").select("stem").limit(1000).collect()]
    split = dataset.split(rows, "stem", [("demo", 9), ("test", 150), ("train", None)], 42).where("wide is not null").groupBy("split").count()
    assert {r["split"]: r["count"] for r in split.collect()} == {"demo": 9, "test": 150, "train": n - 159}


def test_quantiles_without_exchange_reuse(spark):
    rows = spark.range(0, 100_000, 1, 8).select(((F.col("id") * 7919) % 100_000).cast("double").alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        r = metrics.nearest_ranks(rows, "v").first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r["p50"], r["p90"], r["p95"], r["n"]) == (50_000, 90_000, 95_000, 100_000)


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "cer double, wer double, verdict string")
    assert tuple(metrics.overall(none, "cer", "wer").first()) == (0.0, 0.0)
    assert metrics.verdict_counts(none).first()["pct_pass"] == 0.0


def test_early_stop(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.5, 0.5005, 0.5009, 0.99))] + [("b", 0, 0.96)], "g string, k int, v double")
    got = {r["g"]: r for r in metrics.early_stop(rows, "g", "v", ["k"]).collect()}
    assert (got["a"]["best"], got["a"]["seen"], got["a"]["reason"]) == (0.5, 3, "no improvement") and got["b"]["reason"] == "target"


def test_early_stop_stream_agrees(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.5, 0.5005, 0.5009, 0.99))] + [("b", 0, 0.96), ("c", 0, 0.1)], "g string, k int, v double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = jobs.run_available(jobs.early_stops(stream, "g", "k", "v"))
    want = metrics.early_stop(rows, "g", "v", ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_early_stop_is_the_loop(spark):
    rng, rows, want = random.Random(7), [], {}
    for g in range(60):
        vs = [rng.choice([None, round(rng.random(), 2), round(0.5 + k / 100, 3)]) if rng.random() < 0.9 else 0.96 for k in range(rng.randrange(1, 30))]
        rows += [(g, k, v) for k, v in enumerate(vs)]
        best, stale, reason, seen = None, 0, None, 0
        for seen, v in enumerate(vs, 1):
            if best is None or (v is not None and v >= best + 0.05):
                best, stale = v, 0
            else:
                stale += 1
            reason = "target" if best is not None and best >= 0.95 else "no improvement" if stale >= 4 else None
            if reason:
                break
        want[g] = (best, stale, seen, reason)
    got = metrics.early_stop(spark.createDataFrame(rows, "g int, k int, v double"), "g", "v", ["k"], patience=4, epsilon=0.05).collect()
    assert {r["g"]: (r["best"], r["stale"], r["seen"], r["reason"]) for r in got} == want


def test_windows_over_one_large_group(spark):
    n = 50_000
    rows = spark.range(0, n, 1, 8).select(F.lit("all").alias("g"), "id", ((F.col("id") * 7919) % n).cast("double").alias("v")).union(spark.createDataFrame([(None, n, 5.0), (None, n + 1, 7.0)], "g string, id long, v double"))
    got = {(r["g"], r["id"]): r["running_mean"] for r in metrics.running_mean(rows, "g", "v", "id").where("id % 4999 = 0 or g is null").collect()}
    total = np.cumsum((np.arange(n) * 7919) % n)
    assert all(abs(m - (total[i] / (i + 1) if g else 5.0 + (i - n))) < 1e-6 for (g, i), m in got.items()) and len(got) == 13
    medians = {r["g"]: r["v"] for r in rank.upper_median(rows, "g", "v", "id").collect()}
    assert medians == {"all": n // 2, None: 7.0}
    near = relate.near_in_group(rows, "g", "v", 1.0, F.col("id") % 100 == 0).where("near").select("v").collect()
    passing = {float(i * 7919 % n) for i in range(0, n, 100)}
    assert {r["v"] for r in near} == {v + d for v in passing for d in (-1.0, 1.0) if 0 <= v + d < n} | {v for v in passing if v - 1 in passing or v + 1 in passing}


def test_deadline_and_marker(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ref": "abc", "hyp": "abd"}\n')
    stream = spark.readStream.schema("ref string, hyp string").json(f"{tmp_path}/in")
    assert not jobs.run_until(jobs.append(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=False), 1)
    assert jobs.run_until(jobs.append(stream, f"{tmp_path}/out", f"{tmp_path}/ck"), 60) and spark.read.json(f"{tmp_path}/out").count() == 1
    with pytest.raises(TimeoutError):
        jobs.after_marker(spark, f"{tmp_path}/done", lambda: None, 0.2, 0.1)
    (tmp_path / "done").touch()
    assert jobs.after_marker(spark, f"{tmp_path}/done", lambda: "started", 1) == "started"


def test_images_and_crops(spark, tmp_path):
    image = np.arange(30 * 40 * 3, dtype=np.uint8).reshape(30, 40, 3)
    images = spark.createDataFrame([("d/s_1.png", 30, 40, 3, image.tobytes())], "image_path string, height int, width int, nChannels int, data binary")
    labels = spark.createDataFrame([("d/s_1.png", [40, 30], [("text", [8, 8, 20, 16], "ab"), ("text", [8, 8, 20, 16], "zz")]), ("gone.png", [40, 30], [("text", [8, 8, 20, 16], "ab")])], "image_path string, canvas_size array<int>, elements array<struct<type:string,bbox:array<int>,text:string>>")
    known = dataset.dictionary_column(spark.createDataFrame([("a",), ("b",)], "ch string"))
    rows, seen = dataset.watched(dataset.crop_candidates(labels, known), kept=F.col("fate") == "crop", unknown=F.col("fate") == "oov")
    cut = dataset.crops(rows, images).collect()
    assert [(r["crop_path"], r["text"]) for r in cut] == [("crops/s_1__00.png", "ab")] and seen.get == {"rows": 3, "kept": 2, "unknown": 1}
    (tmp_path / "one.png").write_bytes(cut[0]["png"])
    back = readers.images(spark, f"{tmp_path}/one.png").first()
    assert (imaging.from_image_row(back["height"], back["width"], back["nChannels"], back["data"]) == image[4:20, 4:24]).all() and imaging.readable(cut[0]["png"]) and not imaging.readable(cut[0]["png"][:-9])
    traced = images.select(imaging.traced(imaging.Preprocess(tophat_least=3, tiles=2, pad=2))(F.struct("height", "width", "nChannels", "data")).alias("t")).select("t", imaging.last_stage(F.col("t")).alias("done")).first()
    want = imaging.stages(image, imaging.Preprocess(tophat_least=3, tiles=2, pad=2))
    assert [(s["stage"], bytes(s["data"])) for s in traced["t"]] == [(n, a.tobytes()) for n, a in want] and (traced["done"]["height"], traced["done"]["width"]) == (34, 44)
    split = labels.where("image_path <> 'gone.png'").withColumn("split", F.lit("test"))
    files = spark.createDataFrame([("d/s_1.png", bytearray(cut[0]["png"]))], "path string, content binary")
    sinks.split_sets(split, f"{tmp_path}/sets", files)
    assert (tmp_path / "sets" / "test" / "images" / "s_1.png").read_bytes() == cut[0]["png"] and (tmp_path / "sets" / "split=test").exists()
    with pytest.raises(Exception, match="missing: gone"):
        sinks.split_sets(labels.withColumn("split", F.lit("test")), f"{tmp_path}/more", files)


def test_pictures_and_thumbnails(spark, tmp_path):
    labels = synth.screens(spark, 24, seed=3)
    assert sinks.image_files(synth.pictures(labels), str(tmp_path)) == 24
    images = readers.images(spark, f"{tmp_path}/images/*.png")
    first = images.first()
    assert images.count() == 24 and (first["height"], first["width"]) == (240, 320)
    gray = imaging.from_image_row(first["height"], first["width"], first["nChannels"], first["data"])
    assert gray.max() > 100
    for kind in ("solid_gray", "vignette", "gradient_horiz", "gradient_vert", "toast_bottom", "solid_black"):
        assert imaging.background(kind, 32, 20).shape == (20, 32)
    assert imaging.background("vignette", 32, 20)[10, 16] == 45 and imaging.background("toast_bottom", 32, 20)[-1, 0] == 60
    assert imaging.thumbnail(np.tile([0, 100], (320, 260)).astype(np.uint8)).tolist() == np.full((160, 260), 50).tolist()
    assert imaging.thumbnail(np.zeros((1000, 10, 3), np.uint8)).shape == (160, 2, 3) and imaging.thumbnail(np.ones((5, 5), np.uint8)).shape == (5, 5)
    small = images.select(imaging.thumbnails()(F.struct("height", "width", "nChannels", "data")).alias("png")).limit(2).collect()
    rows = spark.createDataFrame([(1, "a", "t", "r", 0.5, 1.0, "FAIL", bytearray(small[0]["png"]), None), (2, "b", "t", "r", 0.0, 0.0, "PASS", bytearray(small[1]["png"]), bytearray(small[0]["png"]))], "row int, filename string, test_text string, ref_text string, cer double, wer double, verdict string, test_png binary, ref_png binary")
    import io

    with zipfile.ZipFile(io.BytesIO(sinks.workbook(rows))) as z:
        assert sorted(n for n in z.namelist() if "media" in n) == [f"xl/media/p{k}.png" for k in (1, 2, 3)] and z.read("xl/media/p2.png") == small[1]["png"]
        drawing = z.read("xl/drawings/drawing1.xml").decode()
        assert drawing.count("<xdr:pic>") == 3 and '<drawing r:id="r1"/>' in z.read("xl/worksheets/sheet1.xml").decode()
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                xml.etree.ElementTree.fromstring(z.read(name))


def test_label_sources(spark, tmp_path):
    for name in ("seed", "chunk_02", "chunk_01", "chunk_03"):
        (tmp_path / name).mkdir()
    for name in ("seed", "chunk_02", "chunk_01"):
        (tmp_path / name / "labels.jsonl").write_text('{"image_path": "images/a.png"}\n\n{broken\n')
    found = readers.chunk_files(spark, str(tmp_path), f"{tmp_path}/seed")
    assert [f.rsplit("/", 2)[1] for f in found] == ["seed", "chunk_01", "chunk_02"] and readers.rejected(spark, found) == 3
    with pytest.raises(FileNotFoundError):
        readers.chunk_files(spark, f"{tmp_path}/seed")
    assert [r["image_path"] for r in readers.manifest_or_folder(spark, f"{tmp_path}/seed").where("image_path is not null").collect()] == [f"{tmp_path}/seed/images/a.png"]
    assert readers.manifest_or_folder(spark, f"{tmp_path}/seed/labels.jsonl").where("image_path = 'images/a.png'").count() == 1
    assert sinks.resumed(spark, f"{tmp_path}/none", False) == "append"
    with pytest.raises(ValueError, match="already"):
        sinks.resumed(spark, f"{tmp_path}/seed", False)
    with pytest.raises(ValueError, match="sizes"):
        dataset.split(spark.range(3), "id", [("a", None), ("b", 2)], 1)


def test_vocabulary_is_a_parameter(spark):
    own = {"xx": {"options": ["uno", "due", "tre"], "title": ["Titolo"]}}
    rows = synth.screens(spark, 40, vocabulary=own)
    assert {r["language"] for r in rows.collect()} == {"xx"} and rows.where("raw_text like '%Titolo%'").count() > 0
    assert rows.where("pattern = 'message'").first()["raw_text"].split("\n")[-1] in synth.WORDS["en"]["message"]  # what a language lacks is English
    with pytest.raises(ValueError):
        synth.screens(spark, 1, languages=[])
    english = synth.screens(spark, 300, languages=["en"], patterns=["timer"])
    assert english.where("raw_text like '%Today AM%'").count() > 50 and english.where("raw_text like '%[PLAY_PAUSE]%'").count() > 150


def test_scores_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ref": "abc", "hyp": "abd"}\n{"ref": "", "hyp": ""}\n')
    stream = spark.readStream.schema("ref string, hyp string").json(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.score_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["verdict"] for r in spark.read.json(f"{tmp_path}/out").collect()) == ["FAIL", "PASS"]


def test_characters(spark):
    rows = spark.createDataFrame([("en", "aab\n"), ("el", "α😀"), ("en", None), ("en", "")], "lang string, t string")
    got = {(r["lang"], r["ch"]): r["n"] for r in dataset.char_counts(rows, "t", "lang").collect()}
    assert got == {("en", "a"): 2, ("en", "b"): 1, ("el", "α"): 1, ("el", "😀"): 1}
    counts = {r["block"]: r["n"] for r in metrics.block_counts(dataset.char_counts(rows, "t")).collect()}
    assert counts["ASCII"] == 2 and counts["Greek"] == 1 and counts["Thai"] == 0
    known = dataset.dictionary_column(spark.createDataFrame([("a",), ("b",)], "ch string"))
    texts = spark.createDataFrame([(0, "ab a"), (1, "caZc")], "i int, t string").select("i", dataset.in_dictionary(F.col("t"), known).alias("ok"), dataset.bad_chars(F.col("t"), known).alias("bad"))
    assert [(r["ok"], r["bad"]) for r in texts.orderBy("i").collect()] == [(True, [" "]), (False, ["Z", "c"])]


def test_splits(spark):
    rows = spark.range(100)
    parts = dataset.split(rows, "id", [("demo", 5), ("test", 20), ("train", None)], 42)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"demo": 5, "test": 20, "train": 75}
    again = dataset.split(rows.repartition(7), "id", [("demo", 5), ("test", 20), ("train", None)], 42)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, parts.collect()))
    assert dataset.disjoint(parts.where("split = 'demo'"), parts.where("split = 'test'"), "id")
    assert sorted(r["count"] for r in dataset.balanced(spark.range(10), "id", list("abc"), 1).groupBy("item").count().collect()) == [3, 3, 4]
    assert dataset.exact_permutation(5, 42) == [3, 1, 2, 4, 0]


def test_manifest_first_wins(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "image_path string, line_ord int, v string")
    b = spark.createDataFrame([("p", 0, "z"), ("r", 1, "w")], "image_path string, line_ord int, v string")
    assert {r["image_path"]: r["v"] for r in dataset.manifest([a, b]).collect()} == {"p": "x", "q": "y", "r": "w"}


def test_labels_round_trip(spark, tmp_path):
    made = synth.screens(spark, 40, seed=1)
    assert made.groupBy("language", "pattern").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    later = synth.screens(spark, 5, start=30, seed=1)
    assert sorted(map(repr, later.collect())) == sorted(map(repr, made.where("cast(regexp_extract(image_path, '_([0-9]+)_', 1) as int) between 30 and 34").collect()))
    sinks.json_lines(made, f"{tmp_path}/labels")
    back = readers.labels(spark, f"{tmp_path}/labels", "strict")
    assert back.count() == 40 and sorted(map(repr, back.collect())) == sorted(map(repr, made.collect()))
    (tmp_path / "bad.jsonl").write_text('{"image": "i.png", "text": "hi"}\n\n{broken\n')
    rows = readers.truth(readers.labels(spark, f"{tmp_path}/bad.jsonl", "tolerant", schema.LABELS_ANY))
    assert [(r["image_path"], r["truth"]) for r in rows.collect()] == [("i.png", "hi")]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.labels(spark, f"{tmp_path}/bad.jsonl", "strict").collect()
    chunk = readers.chunks(spark, [f"{tmp_path}/bad.jsonl"])
    assert chunk.count() == 2 and readers.existing(spark, [f"{tmp_path}/bad.jsonl", f"{tmp_path}/none"]) == [f"{tmp_path}/bad.jsonl"]
    with pytest.raises(ValueError):
        synth.screens(spark, 1, languages=["xx"])


def test_lists_and_dictionary(spark, tmp_path):
    labels = synth.screens(spark, 12)
    sinks.tab_list(dataset.detection_list(labels), f"{tmp_path}/det", "image_path", "polygons")
    assert readers.detection_list(spark, f"{tmp_path}/det").where("size(polygons) > 0").count() == 12
    counts = dataset.char_counts(labels.withColumnRenamed("language", "language"), "raw_text", "language")
    sinks.dictionary(counts, f"{tmp_path}/dict")
    chars = [r["ch"] for r in readers.charset(spark, f"{tmp_path}/dict").collect()]
    assert chars == sorted(set(chars)) and " " in chars
    doc = json.loads(sinks.coverage(counts, spark.createDataFrame([("s", 12)], "source string, n long")))
    assert doc["total_unique_chars"] == len(chars) and doc["samples_per_source"] == {"s": 12} and len(doc["top_50_global"]) <= 50
    rec = dataset.recognition_list(labels, dataset.dictionary_column(counts))
    assert rec.where("known").count() == rec.count() > 12
    (tmp_path / "log.txt").write_text("cur metric, precision: 0.1, hmean: 0.91\nnothing\nhmean: 0.5\n")
    assert [r["hmean"] for r in readers.metric_values(spark.read.text(f"{tmp_path}/log.txt")).collect()] == [0.91] and readers.line_count(spark, f"{tmp_path}/log.txt") == 3


def test_tagged_results(spark, tmp_path):
    row = '{"image_path": "a", "ref": "x", "hyp": "x", "cer": 0.0, "wer": 0.0}\n'
    for name in ("raw_results.jsonl", "v2_preprocessed_results.jsonl"):
        (tmp_path / name).write_text(row)
    got = {(r["tag"], r["mode"]) for r in readers.tagged_results(spark, str(tmp_path)).collect()}
    assert got == {("", "raw"), ("v2", "preprocessed")}


def test_workbook_and_markdown(spark):
    rows = spark.createDataFrame([(1, "a<b.png", "t", "r", 0.5, 1.0, "FAIL"), (2, "b", None, "", 0.0, 0.0, "PASS")], "row int, filename string, test_text string, ref_text string, cer double, wer double, verdict string")
    import io

    with zipfile.ZipFile(io.BytesIO(sinks.workbook(rows, ["only.png"]))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b.png" in sheet and 'topLeftCell="C2"' in sheet and sheet.count("<row>") == 3 and "only.png" in z.read("xl/worksheets/sheet2.xml").decode()
    assert sinks.markdown(["k", "cer"], [("en", 0.125)]).endswith("| en | 12.5% |")


def fake_reader():
    class Fake:
        """Reads the colour of the first pixel as a text; a second reading sees the time."""

        def __call__(self, image, **settings):
            corners = [[0.0, 0.0], [50.0, 0.0], [50.0, 10.0], [0.0, 10.0]]
            if settings.get("side") == 320:
                return [(corners, "1:30", 0.9)]
            return [(corners, {0: "1h3om", 1: "LG Thino"}.get(int(image[0, 0, 0]), "plain"), 0.8)]

    return Fake


def test_recognition(spark):
    images = spark.createDataFrame([(k, 2, 2, 3, bytes(np.full(12, k, np.uint8))) for k in range(3)], "id int, height int, width int, nChannels int, data binary")
    plain = {r["id"]: r["text"] for r in evaluate.recognise(images, fake_reader()).collect()}
    assert plain == {0: "1h3om", 1: "LG ThinQ", 2: "plain"}


def test_second_recognition(spark):
    images = spark.createDataFrame([(k, 2, 2, 3, bytes(np.full(12, k, np.uint8))) for k in range(3)], "id int, height int, width int, nChannels int, data binary")
    custom = {r["id"]: (r["text"], r["n_boxes"]) for r in evaluate.recognise(images, fake_reader(), custom=True).collect()}
    assert custom == {0: ("1 hr 30 min", 1), 1: ("LG ThinQ", 1), 2: ("plain", 1)}


def test_report_plans(spark):
    rows = evaluate.scored(spark.createDataFrame([(f"i{k}", "en" if k % 2 else "ru", "toast", "solid_black", "abcd", "abcd" if k % 3 else "xbcd") for k in range(12)], "image_path string, language string, pattern string, background string, ref string, hyp string"), unicode=False)
    tables = evaluate.report(rows)
    assert tables["verdicts"].first()["n"] == 12 and tables["groups"].where("grouping = 'script'").count() == 2
    plan = tables["groups"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") + plan.count("Generate  explode") <= 2 and "TakeOrderedAndProject" in tables["worst"]._jdf.queryExecution().executedPlan().toString()


def test_catalogue_keeps_its_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
