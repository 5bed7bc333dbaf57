"""Aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relate import in_ranges

#: Ranges of code points by block, ends included.
BLOCKS = {
    "ASCII": (0x20, 0x7E), "Latin-1 Supplement": (0xA0, 0xFF), "Latin Extended-A": (0x100, 0x17F),
    "Latin Extended-B": (0x180, 0x24F), "Greek": (0x370, 0x3FF), "Cyrillic": (0x400, 0x4FF),
    "Arabic": (0x600, 0x6FF), "Thai": (0xE00, 0xE7F), "CJK": (0x4E00, 0x9FFF),
}


def means(*columns: str) -> list[Column]:
    """Means that are 0 on no rows."""
    return [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns]


def by_group(rows: DataFrame, key: Column | str, order: str = "mean_cer") -> DataFrame:
    """A1 (order "n") and A2 (order "mean_cer"): size and mean rates of each group, ties by key."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), *means("cer", "wer")).orderBy(F.desc(order), "key")


def overall(rows: DataFrame, *columns: str) -> DataFrame:
    """A3."""
    return rows.agg(*means(*columns))


def verdict_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many passed, and the shares in percent."""
    n = F.count("*")
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "WARN", "FAIL")]
    shares = [F.when(n > 0, F.count_if(F.col("verdict") == v) * 100.0 / n).otherwise(0.0).alias(f"pct_{v.lower()}") for v in ("PASS", "WARN", "FAIL")]
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(n.alias("n"), *counts, *shares, *means("cer"))


def nearest_ranks(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Mean, greatest, and for each share q the value at place floor(n * q) from 0 in order.

    Counts of equal values are summed first, in one pass over the rows, and ranked by running
    totals over ranges of values, so no task sorts all rows or values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")).withColumn("_all", F.lit(0))
    placed = in_ranges(counted, ["_all"], ["v"], {"_sum_before": F.sum("k")}, {"_sum_after": F.sum("k")})
    part = Window.partitionBy("_part")
    run = F.coalesce("_sum_before", F.lit(0)) + F.sum("k").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.coalesce("_sum_before", F.lit(0)) + F.sum("k").over(part) + F.coalesce("_sum_after", F.lit(0))
    ends = placed.select("v", "k", run.alias("end"), n.alias("n"))
    at = lambda q: F.floor(F.col("n") * q)
    picks = [F.max(F.when((at(q) >= F.col("end") - F.col("k")) & (at(q) < F.col("end")), F.col("v"))).alias(f"p{round(q * 100)}") for q in shares]
    mean = F.coalesce(F.sum(F.col("v") * F.col("k")) / F.sum("k"), F.lit(0.0)).alias("mean")
    return ends.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"), mean, F.max("v").cast("double").alias("max"), *picks)


def groupings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Independent groupings of one input in one pass, as (grouping, key, n, mean_cer, mean_wer)."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("key")) for k in keys]))
    return rows.select(sides.alias("g"), "cer", "wer").groupBy("g.grouping", "g.key").agg(F.count("*").alias("n"), *means("cer", "wer"))


def block_counts(chars: DataFrame, column: str = "ch") -> DataFrame:
    """How many different characters lie in each block."""
    cp = F.ascii(column)
    own = chars.select(cp.alias("cp")).distinct()
    row = own.agg(*[F.count_if(F.col("cp").between(lo, hi)).alias(name) for name, (lo, hi) in BLOCKS.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.col(f"`{k}`").alias("n")) for k in BLOCKS])).alias("r")).select("r.*")


def running_mean(rows: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    """Mean of the rows up to each one, within its group; a group goes on from range to range with its sum and count."""
    placed = in_ranges(rows, [group], list(order), {"_sum_before": F.sum(value), "_count_before": F.count(value)})
    w = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_sum_before", F.lit(0.0)) + F.coalesce(F.sum(value).over(w), F.lit(0.0))
    count = F.coalesce("_count_before", F.lit(0)) + F.count(value).over(w)
    return placed.withColumn("running_mean", F.when(count > 0, total / count)).drop("_part", "_sum_before", "_count_before")


#: Rows of a series that are folded at a time.
SERIES_BLOCK = 1024


def early_stop(rows: DataFrame, group: str, value: str, order: list[str], target: float = 0.95, patience: int = 2, epsilon: float = 0.001, block: int = SERIES_BLOCK) -> DataFrame:
    """The state after each group's series: best, rounds without gain, why and where it stopped.

    A value gains if it reaches the best plus ``epsilon``; a best that reaches the target stops at
    once, ``patience`` rounds without gain stop too. The first value gains; a null never does, nor does one before it count as a round.

    A gain lies at most ``patience`` rows behind the one before, else the series has stopped. So
    each row points to the gain that would follow it, over a few rows ahead; blocks of ``block``
    rows are folded into tables of where each of their first ``patience`` rows leads to, and a
    group's blocks are passed table by table. No task holds a series.
    """
    size = max(block, 4 * patience)
    narrow = rows.select(group, *order, F.col(value).cast("double").alias("v"))
    placed = in_ranges(narrow, [group], order, {"_count_before": F.count("*")})
    part = Window.partitionBy(group, "_part").orderBy(*order)
    at = F.coalesce("_count_before", F.lit(0)) + F.row_number().over(part) - 1
    placed = placed.select(group, at.alias("at"), "v")
    # The first rows of a block are also seen from the one before.
    own = F.floor(F.col("at") / size)
    seen_from = F.when((F.col("at") % size < patience) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ahead = Window.partitionBy(group, "b").orderBy("at")
    later = [F.lead("v", k).over(ahead) for k in range(1, patience + 1)]
    gain = F.coalesce(*[F.when(v >= F.col("v") + epsilon, F.lit(k)) for k, v in enumerate(later, 1)], F.lit(0))
    step = F.when(F.col("v").isNull(), 1).when(F.col("v") >= target, 0).otherwise(gain)  # nulls only before the first value
    linked = placed.withColumn("b", F.explode(seen_from)).withColumn("step", step).where(F.floor(F.col("at") / size) == F.col("b"))
    blocks = linked.groupBy(group, "b").agg(F.sort_array(F.collect_list(F.struct("at", "step", "v"))).alias("rows"))
    # From the block's row k on: the row that is reached, and the best when it is known.
    spot = lambda p, v: F.struct(p.cast("long").alias("at"), v.cast("double").alias("v"))
    begin = F.transform(F.sequence(F.lit(0), F.lit(patience - 1)), lambda k: spot(F.col("b") * size + k, F.lit(None)))
    move = lambda acc, r: F.transform(acc, lambda x: F.when(x["at"] == r["at"], spot(r["at"] + r["step"], r["v"])).otherwise(x))
    tables = blocks.select(group, "b", F.aggregate("rows", begin, move).alias("ends"), F.size("rows").alias("n"))
    series = tables.groupBy(group).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("b", "ends"))).alias("blocks"))

    def through(acc, x):
        k = acc["at"] - x["b"] * size
        return F.when((k >= 0) & (k < patience), F.get(x["ends"], k.cast("int"))).otherwise(acc)

    last = series.select(group, "n", F.aggregate("blocks", spot(F.lit(0), F.lit(None)), through).alias("f"))
    found = F.col("f.v").isNotNull()
    gained = F.when(found, F.col("f.at") + 1).otherwise(F.col("n"))  # without any value nothing is lost either
    seen = F.when(F.col("f.v") >= target, gained).otherwise(F.least("n", gained + patience))
    reason = F.when(F.col("f.v") >= target, "target").when(F.col("n") - gained >= patience, "no improvement")
    return last.select(group, F.col("f.v").alias("best"), (seen - gained).cast("int").alias("stale"), seen.cast("int").alias("seen"), reason.alias("reason"))


def time_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, mean and total of the time each row took, in milliseconds; 0 on no rows."""
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(F.count("*").alias("n"), F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)).alias("total_ms"))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their share of the total in percent; 0 where there is nothing."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.when(F.col("_total") > 0, F.col(n) * 100.0 / F.col("_total")).otherwise(0.0)).drop("_total")
