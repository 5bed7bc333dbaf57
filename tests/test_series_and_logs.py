"""Neighbours to the right, early stops without collected series, logs by file and as they grow, character counts in pieces."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from screenlab.operators import dataset, metrics, relate
from screenlab.sources import readers
from screenlab.streaming import jobs


def loop(vs, target, patience, epsilon):
    best, stale, seen = None, 0, 0
    for seen, v in enumerate(vs, 1):
        if best is None or (v is not None and v >= best + epsilon):
            best, stale = v, 0
        else:
            stale += 1
        if best is not None and best >= target:
            return best, stale, seen, "target"
        if stale >= patience:
            return best, stale, seen, "no improvement"
    return best, stale, seen, None


@pytest.mark.parametrize("block", [1, 13, 1024])
def test_early_stop_in_blocks_is_the_loop(spark, block):
    rng, series = random.Random(block), {}
    for g in range(40):
        vs = [round(0.3 + k * rng.choice([0, 0.01, 0.011]), 3) if rng.random() < 0.9 else None for k in range(rng.randrange(1, 90))]
        series[g] = vs
    series[49] = [None] * 9
    series[48] = [None] * 9 + [0.5, None, 0.6]
    series[50] = [0.5, 0.501, 0.502, 0.5029, 0.503]  # exactly the least gain counts
    series[51] = [0.5] * 7
    series[52] = [0.001 * k for k in range(700)]
    rows = [(g, k, v) for g, vs in series.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(5)
    for patience, epsilon in ((2, 0.001), (5, 0.01), (3, 0.0)):
        got = {r["g"]: (r["best"], r["stale"], r["seen"], r["reason"]) for r in metrics.early_stop(df, "g", "v", ["k"], 0.95, patience, epsilon, block).collect()}
        assert got == {g: loop(vs, 0.95, patience, epsilon) for g, vs in series.items()}


def test_early_stop_of_a_long_rising_series(spark):
    n = 300_000
    rows = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), "id", (F.col("id") * 1e-6).alias("v"))
    r = metrics.early_stop(rows, "g", "v", ["id"], 0.95, 2, 1e-7).first()
    assert (r["seen"], r["stale"], r["reason"]) == (n, 0, None) and abs(r["best"] - (n - 1) * 1e-6) < 1e-12


def boxes(n, groups, seed):
    rng = random.Random(seed)
    ys = [rng.choice([0.0, 12.0, 24.0, rng.uniform(-40, 40), float(rng.randrange(-30, 30))]) for _ in range(n)]
    return [(i, rng.randrange(groups) if i % 17 else None, ys[i] if i % 29 else None, rng.randrange(60), rng.random() < 0.3, "wide") for i in range(n)]


@pytest.mark.parametrize("n,groups", [(400, 6), (300, 1), (0, 1)])
def test_right_neighbour_equals_brute_force(spark, n, groups):
    rows = boxes(n, groups, n)
    df = spark.createDataFrame(rows, "id int, g int, y double, x int, word boolean, near string").withColumnRenamed("near", "other").repartition(3)
    got = {r["id"]: r["near"] for r in relate.right_neighbour(df, "g", "y", "x", 12, F.col("word")).collect()}
    want = {a[0]: any(b[0] != a[0] and b[1] == a[1] and b[4] and b[2] is not None and abs(a[2] - b[2]) <= 12 and b[3] >= a[3] for b in rows) if a[1] is not None and a[2] is not None else False for a in rows}
    assert got == want


def test_right_neighbour_of_one_large_group(spark):
    """Every row of one band and group, and spread over many: a neighbour answers wherever it stands."""
    n = 60_000
    one = spark.range(0, n, 1, 8).select("id", F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("y"), F.col("id").alias("x"), (F.col("id") % 1000 == 0).alias("word"))
    got = relate.right_neighbour(one, "g", "y", "x", 12, F.col("word")).where("near").agg(F.max("id"), F.count("*")).first()
    last = (n - 1) // 1000 * 1000
    assert tuple(got) == (last - 1, last)


def test_log_values_fall_back_by_whole_logs(spark):
    lines = [("a", 1, "cur metric, precision: 0.1, hmean: 0.70"), ("a", 2, "best metric, hmean: 0.80"), ("a", 3, "cur metric, hmean: 0.75"), ("b", 1, "hmean : 0.5, hmean: 0.6"), ("b", 2, "hmean: 0.7."), ("b", 3, "cur metric, nothing"), ("c", 1, "no value"), (None, 1, "hmean: 0.9")]
    df = spark.createDataFrame(lines, "log string, at int, value string")
    got = sorted((tuple(r) for r in readers.metric_values(df, "at", source="log").select("log", "at", "seq", "hmean").collect()), key=str)
    assert got == sorted([("a", 1, 0, 0.7), ("a", 3, 0, 0.75), ("b", 1, 0, 0.5), ("b", 1, 1, 0.6), (None, 1, 0, 0.9)], key=str)
    whole = readers.metric_values(df.where("log = 'a'")).orderBy("at")
    assert [r["hmean"] for r in whole.collect()] == [0.7, 0.75]
    assert readers.metric_values(df.where("false")).isEmpty()


def test_watch_of_growing_logs(spark, tmp_path):
    """Looks at a log that grows: other lines until one names the current metric, then places already seen stay seen."""
    looks = [["hmean: 0.40", "hmean: 0.50"], ["hmean: 0.45"], ["cur metric, hmean: 0.10", "cur metric, hmean: 0.20", "cur metric, hmean: 0.30", "cur metric, hmean: 0.60"], ["best metric, hmean: 0.99"], ["cur metric, hmean: 0.61"], ["cur metric, hmean: 0.60", "cur metric, hmean: 0.99"]]
    for k, look in enumerate(looks):
        spark.createDataFrame([("log", 100 * k + i, v) for i, v in enumerate(look)], "log string, at int, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("log string, at int, value string").parquet(f"{tmp_path}/in")
        watch = jobs.watch_logs(stream, "log", "at", 0.95, 3, 0.05)
        sink = watch.writeStream.foreachBatch(lambda b, i: b.write.mode("append").json(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        sink.start().awaitTermination()
    got = Counter(spark.read.schema("best double, stale int, seen long, reason string").json(f"{tmp_path}/out").select("best", "stale", "seen", F.coalesce("reason", F.lit("-"))).collect())
    got = Counter(tuple(r) for r in got.elements())
    # 0.40 0.50 | 0.45 | the first three places of the new kind were looked at, 0.60 gains | nothing new | 0.61 | 0.60, and 0.99 that gains in the same look
    assert got == Counter([(0.5, 0, 2, "-"), (0.5, 1, 3, "-"), (0.6, 0, 4, "-"), (0.6, 0, 4, "-"), (0.6, 1, 5, "-"), (0.99, 0, 7, "target")])


def test_watch_ends_at_its_deadline(spark, tmp_path):
    spark.createDataFrame([("log", 1, "hmean: 0.40")], "log string, at int, value string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("log string, at int, value string").parquet(f"{tmp_path}/in")
    watch = jobs.watch_logs(stream, "log", "at", deadline=1.0)
    query = watch.writeStream.foreachBatch(lambda b, i: b.write.mode("append").json(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    assert not jobs.run_until(query, 12)
    reasons = [r["reason"] for r in spark.read.schema("reason string, seen long").json(f"{tmp_path}/out").collect()]
    assert sorted(map(str, reasons)) == ["None", "deadline"]


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_char_counts_in_pieces(spark, monkeypatch, piece):
    from pyspark import cloudpickle

    monkeypatch.setattr(dataset, "COUNT_CHARS", piece)
    cloudpickle.register_pickle_by_value(dataset)  # the workers get this module as it is here
    try:
        texts = ["abcabc", "zé𝄞a\n", "", None, "a" * 50 + "q", "abc"]
        df = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "i int, t string, k string")
        want = Counter(c for t in texts if t for c in t if c >= " ")
        got = dataset.char_counts(df, "t").collect()
        assert {r["ch"]: r["n"] for r in got} == want
        first = {}
        for i, t in enumerate(texts):
            for p, c in enumerate(t or ""):
                first.setdefault(c, (i, p))
        got = dataset.char_counts(df, "t", order="i").collect()
        assert {r["ch"]: (r["n"], *r["first"]) for r in got} == {c: (n, *first[c]) for c, n in want.items()}
    finally:
        cloudpickle.unregister_pickle_by_value(dataset)
