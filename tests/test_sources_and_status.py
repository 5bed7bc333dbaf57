"""Labels as a data source, short vocabularies, status files, manifests of arriving chunks, coverage of polygons."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.functions import imaging
from screenlab.operators import dataset, relate
from screenlab.plans import synth
from screenlab.sources import label_source
from screenlab.streaming import jobs


def names(df):
    return sorted(map(repr, df.collect()))


def test_label_source_gives_the_rows_of_the_plan(spark):
    want = names(synth.screens(spark, 50, start=7, seed=3, languages=["en", "el"]))
    for rows in (1, 13, 1000):
        assert names(label_source.label_table(spark, start=7, count=50, seed=3, languages="en,el", rowsPerPartition=rows)) == want
    assert label_source.label_table(spark, count=0).isEmpty()
    with pytest.raises(Exception, match="unknown"):
        label_source.label_table(spark, count=1, languages="xx").collect()


def test_label_stream_goes_on_behind_its_offset(spark, tmp_path):
    for count in (20, 20, 50):
        rows = label_source.label_stream(spark, count=count, seed=5, rowsPerPartition=9)
        jobs.append(rows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        made = spark.read.schema(rows.schema).json(f"{tmp_path}/out")
        assert made.count() == count and names(made) == names(synth.screens(spark, count, seed=5))


def test_vocabularies_of_few_options(spark):
    for n in (1, 2, 3, 5):
        words = {"de": {**synth.WORDS["en"], "options": [f"o{k}" for k in range(n)]}}
        for row in synth.screens(spark, 24, patterns=["carousel", "list_check"], vocabulary=words).collect():
            own = [e["text"] for e in row["elements"] if e["type"] == "text"][1:]
            assert len(own) == 3 and len(set(own)) == min(3, n) and set(own) <= set(words["de"]["options"])


def test_plan_from_a_table(spark):
    plan = spark.range(30).select((F.col("id") * 3).alias("index"), F.lit("timer").alias("pattern"), F.lit("fr").alias("language"), F.lit(1).alias("seed"))
    assert names(synth.planned(plan, 9)) == names(synth.planned(plan.repartition(7), 9)) and synth.planned(plan.where("false")).isEmpty()
    with pytest.raises(Exception, match="unknown"):
        synth.planned(plan.withColumn("pattern", F.lit(None).cast("string"))).collect()


def test_status_files(spark, tmp_path):
    listener = jobs.StatusFiles(spark, str(tmp_path / "status"))
    spark.streams.addListener(listener)
    read = lambda name: json.loads((tmp_path / "status" / name).read_text())

    def wait(ready):
        for _ in range(100):
            try:
                if ready():
                    return
            except (FileNotFoundError, json.JSONDecodeError):
                pass
            time.sleep(0.2)
        raise AssertionError("not in time")

    try:
        spark.range(10).write.parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("counted", F.count("*").alias("n"), F.max("id").alias("top"))
        query = rows.writeStream.format("noop").queryName("good").option("checkpointLocation", f"{tmp_path}/c1").trigger(processingTime="200 milliseconds").start()
        wait(lambda: read("good.json")["rows"] == 10)
        assert read("good.json")["state"] == "running" and not (tmp_path / "status/good.done").exists()
        query.stop()
        wait(lambda: read("good.json")["state"] == "ended")
        wait(lambda: (tmp_path / "status/good.done").read_text().startswith("ended"))
        bad = rows.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").queryName("bad").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        wait(lambda: read("bad.json")["state"] == "failed" and "broken" in read("bad.json")["reason"])
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_of_arriving_chunks(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefgh") if rng.random() < 0.9 else None, src, line, f"{src}-{line}") for src in range(5) for line in range(12)]
    df = spark.createDataFrame(rows, "image_path string, src_ord int, line_ord int, v string")
    order, schema = list(range(5)), df.schema
    rng.shuffle(order)
    for src in order:
        df.where(f"src_ord = {src}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        led = jobs.first_wins_stream(stream, "image_path", ["src_ord", "line_ord"])
        led.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert names(relate.first_wins(out, "image_path", "src_ord", "line_ord").select(*schema.names)) == names(relate.first_wins(df, "image_path", "src_ord", "line_ord").select(*schema.names))
    assert out.count() <= 5 * 9  # at most one a key and chunk


def inside(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
            odd = not odd
    return odd


def test_coverage_equals_a_test_of_each_pixel(spark):
    rng = random.Random(4)
    shapes = [[[[rng.uniform(-5, 25), rng.uniform(-5, 20)] for _ in range(rng.randrange(3, 8))] for _ in range(rng.randrange(3))] for _ in range(60)]
    shapes += [[[[2.0, 2.0], [6.0, 2.0], [6.0, 5.0], [2.0, 5.0]]], [[[0.0, 0.0], [1.0, 1.0]]], [], None]
    df = spark.createDataFrame([(i, s, [20, 15], 0) for i, s in enumerate(shapes)] + [(99, shapes[0], None, 0)], "i int, polygons array<array<array<double>>>, canvas_size array<int>, n_positive int")
    got = {r["i"]: r["n_positive"] for r in dataset.polygon_coverage(df).collect()}
    want = {i: sum(any(len(p) > 2 and inside(p, x + 0.5, y + 0.5) for p in s or []) for y in range(15) for x in range(20)) for i, s in enumerate(shapes)} | {99: 0}
    assert got == want and got[60] == 12
    totals = dataset.coverage_totals(dataset.polygon_coverage(df)).first()
    assert tuple(totals)[:3] == (len(want), sum(v > 0 for v in want.values()), sum(want.values()))
    assert tuple(dataset.coverage_totals(dataset.polygon_coverage(df.where("false"))).first()) == (0, 0, 0, 0.0)
    some = dataset.sampled(df, "i", 3, 10)
    assert names(some) == names(dataset.sampled(df.repartition(7), "i", 3, 10)) and some.count() == 10
    assert imaging.filled([[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [3, 1], [3, 3], [1, 3]]], 4, 4).sum() == 16 and np.array_equal(imaging.filled([], 3, 2), np.zeros((2, 3), bool))
