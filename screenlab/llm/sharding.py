"""Sharding by sampled splitters: key ranges of near-equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

#: Bytes aimed at in a range, the least number of ranges, and sampled keys for each.
RANGE_BYTES, LEAST_RANGES, PER_RANGE = 256_000_000, 256, 16


def splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries (h, id) of a size-weighted key sample; ``rows``: h, id, size.

    A row is drawn with a chance in proportion to its size, by a hash of its key, so a second
    run draws the same. The sample has about ``ranges`` * PER_RANGE keys, whatever the input.
    """
    want = ranges * PER_RANGE
    draw = (F.xxhash64("h", "id", F.lit(1)).cast("double") / F.lit(2.0**64)) + 0.5
    got = rows.where(draw < F.col("size") * F.lit(want / max(1, total))).select("h", "id").toPandas()
    got = got.sort_values(["h", "id"], ignore_index=True)
    at = np.unique((np.arange(1, ranges) * len(got)) // ranges)
    picked = got.iloc[at[at < len(got)]].drop_duplicates()
    # A boundary inside a key that others do not share moves to its start: the group stays in one range.
    low = np.iinfo(np.int64).min
    first = ~picked["h"].duplicated()
    return [(int(h), low if f else int(i)) for h, i, f in zip(picked["h"], picked["id"], first, strict=True)]


def range_of(bounds: list[tuple[int, int]]):
    """Number of boundaries at or below a key (h, id)."""
    h = np.array([b[0] for b in bounds], np.int64)
    i = np.array([b[1] for b in bounds], np.int64)

    def find(hs: pd.Series, ids: pd.Series) -> pd.Series:
        x, y = hs.to_numpy(), ids.to_numpy()
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(h), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            m = np.minimum(mid, len(h) - 1)
            below = (h[m] < x) | ((h[m] == x) & (i[m] <= y))
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return pd.Series(lo)

    return F.pandas_udf(find, "long")


def _number(docs: DataFrame) -> Column:
    """doc_id as a number for the order within equal texts: itself, or a hash of what is no number."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id"), F.lit(-1).cast("long"))


def shard(docs: DataFrame, shards: int = 8, whole: float = 0.01, rounds: int = 12) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its shard of near-equal bytes and a gapless slot.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Keys are (hash of the text,
    doc_id), so equal texts are neighbours. A size-weighted sample of keys gives quantile
    boundaries; rows are dealt to these ranges, a range of over twice the aim is sampled
    again and subdivided, inside a hot text by doc_id, until only rows of one key are left in it. Exact sums of the ranges then place
    every row on the line of all bytes, which is cut into ``shards`` equal parts. Equal texts
    of at most ``whole`` of a shard's bytes within a range stay together, so a shard's bytes
    are off by at most that share or its longest text; larger groups are split between rows.

    Result: doc_id, size, text_crc32, shard, slot (0.. within the shard, in key order).
    Rows that repeat a doc_id and text are all kept. Ids may be of any type. Other columns are
    ignored. An empty table gives an empty result. Only ranges meet in one task, never a shard
    or a group; the driver holds the sample and the boundaries, 16 bytes for 16 MB of texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), _number(docs).alias("id"))
    rows = cut(rows)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(LEAST_RANGES, -(-total // RANGE_BYTES))
    bounds = splitters(rows, total, ranges)
    aim = max(1, total // ranges)
    for _ in range(rounds):
        dealt = rows.withColumn("range", range_of(bounds)("h", "id")) if bounds else rows.withColumn("range", F.lit(0).cast("long"))
        sums = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        over = [(r["range"], r["bytes"]) for r in sums.where((F.col("bytes") > 2 * aim) & (F.col("n") > 1)).collect()]
        if not over:
            break
        inside = dealt.where(F.col("range").isin([r for r, _ in over])).select("h", "id", "size")
        mass = sum(b for _, b in over)
        more = sorted(set(bounds) | set(splitters(inside, mass, max(2, 2 * -(-mass // aim)))))
        if more == bounds:
            break
        bounds = more
    sums = sums.toPandas().sort_values("range")  # one row per range
    start = dict(zip(sums["range"].tolist(), (sums["bytes"].cumsum() - sums["bytes"]).tolist(), strict=True))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("range")) if len(start) <= 512 else None
    if offset is None:
        offsets = docs.sparkSession.createDataFrame(pd.DataFrame({"range": list(start), "offset": list(start.values())}), "range long, offset long")
        dealt = dealt.join(offsets, "range")
    else:
        dealt = dealt.withColumn("offset", offset)
    order = Window.partitionBy("range").orderBy("h", "id", "text_crc32")
    group = Window.partitionBy("range", "h")
    placed = dealt.withColumn("ends", F.col("offset") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("slot0", F.row_number().over(order))
    placed = placed.withColumn("begins", F.col("ends") - F.col("size"))
    placed = placed.withColumn("together", F.sum("size").over(group)).withColumn("first", F.min("begins").over(group))
    at = F.when(F.col("together") <= F.lit(whole * total / shards), F.col("first")).otherwise(F.col("begins"))
    placed = cut(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * F.lit(shards) / F.lit(max(1, total)))).cast("int")).select("doc_id", "size", "text_crc32", "range", "shard", "slot0"))
    part = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("slot0").alias("low")).toPandas().sort_values(["shard", "range"])
    part["start"] = part.groupby("shard")["n"].cumsum() - part["n"] - part["low"]
    starts = docs.sparkSession.createDataFrame(part[["shard", "range", "start"]], "shard int, range long, start long") if len(part) else docs.sparkSession.createDataFrame([], "shard int, range long, start long")
    # At most a row per range and shard boundary; Spark broadcasts it while it is small.
    return placed.join(starts, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("start")).cast("long").alias("slot"))
