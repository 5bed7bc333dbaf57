"""Right neighbours as SQL has them: distances as differences of doubles, rows of one key, and rows that no number places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from screenlab.operators import relate

SCHEMA = "id int, g int, y double, x int, word boolean"


def brute(rows, reach):
    """An answer for each row, in order."""
    finite = lambda y: y is not None and math.isfinite(y)
    return [any(None not in (a[0], a[1], a[3], b[0], b[3]) and a[0] != b[0] and a[1] == b[1] and b[4] and finite(a[2]) and finite(b[2]) and abs(a[2] - b[2]) <= reach and b[3] >= a[3] for b in rows) for a in rows]


def answers(spark, rows, reach, partitions=3):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + SCHEMA).repartition(partitions)
    return [r["near"] for r in relate.right_neighbour(df, "g", "y", "x", reach, F.col("word")).orderBy("n").collect()]


def test_reach_is_that_of_differences(spark):
    """13.13 - 1.13 is 12 as doubles are subtracted, 1.13 + 12 is less than 13.13; and 12 is within 12 of what is just below 0."""
    pairs = [(1.13, 13.13), (0.05, 12.05), (-13.13, -1.13), (-1e-17, 12.0), (-12.0, 1e-17), (12.0, 24.000000000000004), (-24.0, -11.999999999999998)]
    rows = [(2 * k + i, k, pair[i], 1 - i, True) for k, pair in enumerate(pairs) for i in (0, 1)]
    rows += [(100 + 2 * k + i, 100 + k, pair[i], i, True) for k, pair in enumerate(pairs) for i in (0, 1)]
    want = brute(rows, 12)
    assert answers(spark, rows, 12) == want and sum(want) == 10  # five of the pairs, from the one side and from the other


@pytest.mark.parametrize("reach", [12.0, 0.1, 7.3])
def test_boundaries_equal_brute_force(spark, reach):
    rng, rows = random.Random(reach), []
    for k in range(700):
        y = rng.choice([round(rng.uniform(-3 * reach, 3 * reach), 2), reach * rng.randrange(-3, 4)])
        y = rng.choice([y, y, math.nextafter(y, math.inf), math.nextafter(y, -math.inf), rng.choice([-1, 1]) * 10.0 ** rng.randrange(-20, 0), y + reach])
        rows.append((k, k % 60, y, rng.randrange(9), rng.random() < 0.5))
    assert answers(spark, rows, reach) == brute(rows, reach)


@pytest.mark.parametrize("partitions", [1, 40])
def test_rows_of_one_key_are_no_neighbours(spark, partitions):
    """Keys that repeat, in one group and several: each row has its own answer, and its key's other rows do not count."""
    rng = random.Random(partitions)
    rows = [(rng.randrange(6), rng.randrange(4), float(rng.randrange(-20, 20)), rng.randrange(12), rng.random() < 0.4) for _ in range(90)]
    rows += [(k, 10 + k, 1.0, x, True) for k in range(5) for x in (1, 1, 2)]  # one key alone in its group
    rows += [(k % 2, 20, 5.0 + k % 3, k, True) for k in range(30)]
    want = brute(rows, 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answers(spark, rows, 12, partitions) == want and any(want) and not all(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_no_number_places(spark):
    ys = [None, math.nan, math.inf, -math.inf, 1e300, 1e300, 6e16, 6e16 + 8, 6e16 + 16, -1e300, 0.0, -0.0, 5e-324]
    rows = [(k, 1, y, k % 3, True) for k, y in enumerate(ys)] + [(None, 1, 1.0, 9, True), (50, 1, 1.0, None, True), (51, None, 1.0, 9, True), (52, 1, 11.0, 0, None)]
    assert answers(spark, rows, 12) == brute(rows, 12)


def test_query_takes_letters_as_its_sql_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    kinds, rng = ["click", "CLICK", "évènement", "abcd1", "view", None], random.Random(3)
    rows = [(k, rng.randrange(20), rng.choice(kinds), round(rng.uniform(-30, 30), 2)) for k in range(400)] + [(5, 3, "click", 1.13), (6, 3, "click", 13.13)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["J7_right_neighbour"]).fetchall())
    assert sorted(map(tuple, entry.queries()["J7_right_neighbour"](spark, str(tmp_path)).collect())) == want
