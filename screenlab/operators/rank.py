"""Picks and orders; ties always go by a named column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relate import in_ranges


def first_per_group(rows: DataFrame, group: str, order: str, groups: int = 4) -> DataFrame:
    """The first row of each of the first ``groups`` groups."""
    first = rows.groupBy(group).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return first.select("r.*").orderBy(order).limit(groups)


def upper_median(rows: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row at place n // 2 of each group. Ranges of a group are numbered by themselves, so no task sorts a group."""
    placed = in_ranges(rows, [group], [value, tie], {"_count_before": F.count("*")}, {"_count_after": F.count("*")})
    part = Window.partitionBy(group, "_part")
    before = F.coalesce("_count_before", F.lit(0))
    placed = placed.withColumn("_at", before + F.row_number().over(part.orderBy(value, tie))).withColumn("_n", before + F.count("*").over(part) + F.coalesce("_count_after", F.lit(0)))
    return placed.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).drop("_at", "_n", "_part", "_count_before", "_count_after")


def best_per_group(rows: DataFrame, group: str, value: str, tie: str, most: int | None = 8) -> DataFrame:
    """The least row of each group, the ``most`` least of these."""
    best = rows.groupBy(group).agg(F.min_by(F.struct(*rows.columns), F.struct(value, tie)).alias("r")).select("r.*").orderBy(value, tie)
    return best.limit(most) if most else best


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of an order; 0 or None is all."""
    ordered = rows.orderBy(*order)
    return ordered.limit(k) if k else ordered


def extremes(rows: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    """The k best and the k worst, both ascending, marked by ``side``."""
    best = rows.orderBy(value, tie).limit(k).withColumn("side", F.lit("best"))
    worst = rows.orderBy(F.desc(value), F.desc(tie)).limit(k).withColumn("side", F.lit("worst"))
    return best.union(worst).orderBy("side", value, tie)


def view(rows: DataFrame, verdicts: list[str], by: str = "worst") -> DataFrame:
    """Chosen verdicts (none chosen: all), worst or best first or by name."""
    kept = rows.where(F.col("verdict").isin(verdicts)) if verdicts else rows
    order = {"worst": [F.desc("cer"), "ord"], "best": [F.asc("cer"), "ord"], "name": [F.lower("filename"), "ord"]}[by]
    return kept.orderBy(*order)


def numbered(rows: DataFrame, name: str, tie: str) -> DataFrame:
    """Report row numbers by lower-cased name. Each range of names is numbered by itself and shifted."""
    placed = in_ranges(rows.withColumn("_k", F.lower(name)).withColumn("_all", F.lit(0)), ["_all"], ["_k", tie], {"_count_before": F.count("*")})
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_k", tie))
    return placed.withColumn("row", (F.coalesce("_count_before", F.lit(0)) + own).cast("long")).drop("_k", "_all", "_part", "_count_before")
