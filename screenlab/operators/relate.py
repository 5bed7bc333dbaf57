"""Pairing and lookups between tables."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of values up to which a lookup table is broadcast.
BROADCAST_BYTES = 64_000_000


def bytes_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes the values of a column take."""
    if isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(column)
    elif isinstance(kind, T.StructType):
        own = sum((bytes_of(column[f.name], f.dataType) for f in kind), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(column, F.lit(8).cast("long"), lambda n, x: n + bytes_of(x, kind.elementType))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a lookup table, if its values take at most ``most`` bytes; else joins shuffle it."""
    size = df.agg(F.sum(sum((bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32)))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; an error where none is set but in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fixed(df: DataFrame) -> DataFrame:
    """``df``, checkpointed: what is derived from it twice sees the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def same(a: str, b: str, *columns: str) -> Column:
    """Equality of columns of two aliases, nulls included."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def in_ranges(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], after: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` in ranges of (group, order), with ``_part``, the range's number, and for each sum what the rows of its group in earlier ranges have.

    ``sums`` are aggregates over rows by names like _sum_x, _count_x, _max_x: over ranges, what the
    name says is taken again (sums for counts). ``after`` has the same for later ranges.
    A group of any size is spread over tasks: in windows over (group, _part) only ranges meet,
    and of each range and group one row is left for the running totals. The ranges are fixed
    before they are counted: planned twice, they could be cut at other rows.
    """
    parts = fixed(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    after = after or {}
    own = parts.groupBy(*group, "_part").agg(*[c.alias(n) for n, c in (sums | after).items()])
    again = lambda n: {"max": F.max, "min": F.min}.get(n.split("_")[1], F.sum)(n)
    before, later = (Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in ("_part", F.desc("_part")))
    own = own.select(
        *group, "_part",
        *[again(n).over(before).alias(n) for n in sums],
        *[again(n).over(later).alias(n) for n in after],
    )
    names = [*sums, *after]
    return parts.alias("a").join(own.alias("b"), same("a", "b", *group, "_part")).select("a.*", *[F.col(f"b.{n}") for n in names])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, at the place of the first (column ``place``)."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("r"), F.min(order).alias("place")).select("r.*", "place")


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the order of sources and lines."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def pair(test: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Full outer join as (key, test, reference, pair_class); both sides have one row for each key."""
    t = test.select(F.col(key), F.struct(*test.columns).alias("test"))
    r = reference.select(F.col(key), F.struct(*reference.columns).alias("reference"))
    kind = F.when(F.col("reference").isNull(), "only_test").when(F.col("test").isNull(), "only_reference").otherwise("matched")
    return t.join(r, key, "full_outer").withColumn("pair_class", kind)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U3."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def attach(rows: DataFrame, truth: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """Left lookup of ``value`` by ``key``, where the last row of a repeated key (by ``ord``) wins."""
    one = truth.groupBy(key).agg(F.max_by(value, "ord").alias(value))
    return rows.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def resolve(rows: DataFrame, listing: DataFrame, candidates: list[Column], out: str = "path") -> DataFrame:
    """The first candidate path that ``listing`` (path) has, else the first candidate.

    One join for all candidates: they are exploded with their rank, and the least rank found wins.
    """
    keyed = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_c", F.array(*candidates))
    tried = keyed.select("_row", F.posexplode("_c").alias("_rank", "path"))
    there = tried.join(listing.select("path").distinct(), "path", "left_semi")
    best = there.groupBy("_row").agg(F.min_by("path", "_rank").alias(out))
    done = keyed.select("_row", F.col("_c")[0].alias("_first")).join(best, "_row", "left")  # repeated rows stay
    return done.select("_row.*", F.coalesce(out, "_first").alias(out))


def assert_present(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Inner join that fails, when it runs, on a row without partner."""
    marked = rows.join(listing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return marked.where(F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean"))).drop("_there")


def with_baseline(base: DataFrame, runs: DataFrame, value: str) -> DataFrame:
    """Every run beside the one-row baseline, and the difference in points."""
    one = base.agg(F.avg(value).alias("baseline"))  # one row by construction
    return runs.crossJoin(F.broadcast(one)).withColumn("delta", F.col(value) - F.col("baseline"))


def near_in_group(rows: DataFrame, group: str, y: str, reach: float, test: Column) -> DataFrame:
    """J7, J8 on tables: rows with another row (passing ``test``) of the group within ``reach`` in ``y``.

    The nearest passing row before and after in the order of ``y`` decides, so a group is
    sorted once, in ranges, instead of joined with itself.
    """
    at = F.when(test, F.col(y))
    placed = in_ranges(rows, [group], [y, "id"], {"_max_before": F.max(at)}, {"_min_after": F.min(at)})
    up, down = (Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in ((y, "id"), (F.desc(y), F.desc("id"))))
    # What follows is what comes before in the other order: a frame to the end would be gone through for each row.
    low = F.coalesce(F.last(at, ignorenulls=True).over(up), F.col("_max_before"))
    high = F.coalesce(F.last(at, ignorenulls=True).over(down), F.col("_min_after"))
    near = F.coalesce(F.col(y) - low <= reach, F.lit(False)) | F.coalesce(high - F.col(y) <= reach, F.lit(False))
    return placed.withColumn("near", near).drop("_part", "_max_before", "_min_after")


def farthest(y: Column, reach: float) -> Column:
    """The largest double whose distance from ``y``, rounded as a difference of doubles is, is at most ``reach``.

    Sums round otherwise than differences: 13.13 - 1.13 is 12, but 1.13 + 12 is less than 13.13. So the sum, its
    rounding error and half a unit of the reach give a double at most one off, and differences decide.
    """
    most = y + reach
    back = most - y
    most = most + ((y - (most - back)) + (F.lit(reach) - back) + math.ulp(reach) / 2)
    step = F.abs(most) * (2.0**-53 + 2.0**-105) + 5e-324  # leads to the next double
    return F.when(most + step - y <= reach, most + step).when(most - y <= reach, most).otherwise(most - step)


def band(y: Column, reach: float) -> Column:
    """Number of the stretch of about ``reach`` in which ``y`` is: any two in one are within the reach, as rounded.

    Counted away from 0 on both sides, as rounding makes stretches shorter in that direction, never longer. Numbers
    beyond all fractions are stretches of their own.
    """
    steps = F.abs(y) / reach
    counted = F.when(y < 0, -1 - F.floor(steps)).otherwise(F.floor(steps)).cast("double")
    return F.when(steps < 2.0**52, counted).otherwise(y * 2.0 ** max(0, math.ceil(-math.log2(reach))))


def running_best(rows: DataFrame, window, out: str, first: str, second: Column | None) -> DataFrame:
    """``rows`` with the greatest ``first`` in the window, ``out``1; if there is a ``second``, values are (x, key), and ``out``2 is the greatest of any other key, ``out``_lost what that is made of.

    What comes and what was best: if their keys differ, the lesser is the best of another key, unless one before was better.
    """
    rows = rows.withColumn(f"{out}1", F.max(first).over(window))
    if second is None:
        return rows
    lesser = F.when(F.col(f"{first}.key") != F.col(f"{out}1.key"), F.least(first, f"{out}1"))
    return rows.withColumn(f"{out}_lost", F.greatest(second, lesser)).withColumn(f"{out}2", F.max(f"{out}_lost").over(window))


def right_neighbour(rows: DataFrame, group: str, y: str, x: str, reach: float, test: Column, key: str = "id") -> DataFrame:
    """J7 on tables, whole: ``rows`` with ``near``, whether a row of another key and the same group that passes ``test`` is within ``reach`` in ``y`` and not left of it in ``x``.

    Bands of ``y`` as high as the reach: all of a row's own band is within it, of the next band
    the beginning and of the one before the end. So running maxima of ``x`` from either side of
    a band answer, and a row asks its neighbours' bands by a row of its own among theirs. Bands
    are swept in ranges, so neither a group nor a band meets in one task, and no pairs are made.
    Where keys repeat, maxima are kept with the best of a second key, as a key's own rows are no
    neighbours. "Within" is what the rounded difference of doubles says. A row without group, ``y``,
    ``x`` or key, or whose ``y`` is not finite, is near nothing.
    """
    height = F.col(y).cast("double")
    some = rows.where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(key).isNotNull() & (F.abs(height) < float("inf")))
    some = some.select(F.col(group).alias("_g"), height.alias("_y"), F.col(x).alias("_x"), F.col(key).alias("_key"), test.alias("_test"))
    repeated = not some.groupBy("_key").count().where("count > 1").isEmpty()
    some = some.withColumns({"_b": band(F.col("_y"), reach), "_low": -farthest(-F.col("_y"), reach), "_high": farthest(F.col("_y"), reach)})
    some = some.withColumns({"_first": band(F.col("_low"), reach), "_last": band(F.col("_high"), reach)})
    b, first, last = F.col("_b"), F.col("_first"), F.col("_last")
    # At one height: who asks back, the rows themselves, who asks ahead, so that the reach is included.
    asks = lambda at, p, kind: F.struct(at.alias("_b"), F.col(p).alias("_p"), F.lit(kind).alias("_kind"))
    places = [asks(b, "_y", 1), F.when((b - 1 >= first) & (b - 1 < b), asks(b - 1, "_low", 0)), F.when((b + 1 <= last) & (b + 1 > b), asks(b + 1, "_high", 2))]
    places += [F.when(b - 1 > first, asks(first, "_low", 0)), F.when(b + 1 < last, asks(last, "_high", 2))]  # by the rounding, or where 1 is none of their units
    own_row = ["_key", "_g", "_y", "_x"] if repeated else ["_key"]
    value = F.struct(F.col("_x").alias("x"), F.col("_key").alias("key")) if repeated else F.col("_x")
    swept = some.select(*{*own_row, "_g", "_x"}, "_test", F.explode(F.array_compact(F.array(*places))).alias("_q"))
    swept = swept.select("*", "_q.*").withColumn("_at", F.when((F.col("_kind") == 1) & F.col("_test"), value)).drop("_q", "_test")
    order, within = ["_p", "_kind", "_key"], ["_g", "_b", "_part"]
    placed = fixed(swept.repartitionByRange("_g", "_b", *order).withColumn("_part", F.spark_partition_id()))
    before = lambda keys, *o: Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    placed = running_best(placed, before(within, *order), "_up", "_at", F.lit(None) if repeated else None)
    seconds, two = ([F.max("_up_lost").alias("_two")], F.col("_two")) if repeated else ([], None)
    own = placed.groupBy(*within).agg(F.max("_at").alias("_one"), *seconds)
    own = running_best(own, before(within[:2], "_part"), "_under", "_one", two)
    own = running_best(own, before(within[:2], F.desc("_part")), "_over", "_one", two)
    placed = running_best(placed, before(within, *[F.desc(c) for c in order]), "_down", "_at", F.lit(None) if repeated else None)
    others = [f"b.{n}{k}" for n in ("_under", "_over") for k in ((1, 2) if repeated else (1,))]
    placed = placed.alias("a").join(own.alias("b"), same("a", "b", *within)).select("a.*", *others)
    best = lambda n: F.when(F.col(f"{n}1.key") != F.col("_key"), F.col(f"{n}1.x")).otherwise(F.col(f"{n}2.x")) if repeated else F.col(f"{n}1")
    hit = lambda *names: F.greatest(*map(best, names)) >= F.col("_x")
    seen = F.when(F.col("_kind") == 0, hit("_down", "_over")).when(F.col("_kind") == 2, hit("_up", "_under")).otherwise(hit("_up", "_under", "_down", "_over"))
    found = placed.groupBy(*own_row).agg(F.coalesce(F.bool_or(seen), F.lit(False)).alias("near"))
    names = {"_key": F.col(f"r.{key}"), "_g": F.col(f"r.{group}"), "_y": F.col(f"r.{y}").cast("double"), "_x": F.col(f"r.{x}")}
    is_row = reduce(Column.__and__, [names[c] == F.col(f"f.{c}") for c in own_row])
    return rows.alias("r").join(found.alias("f"), is_row, "left").select("r.*", F.coalesce("f.near", F.lit(False)).alias("near"))


def with_files(rows: DataFrame, listing: DataFrame, key: str = "image_path") -> DataFrame:
    """The rows, whole, whose file ``listing`` (path) has; the others are left out. A repeated path counts once."""
    return rows.join(listing.select(F.col("path").alias(key)), key, "left_semi")


def two_runs(base: DataFrame, ours: DataFrame, key: str, value: str = "cer") -> DataFrame:
    """(key, base, ours, delta) of the rows of two runs over the same files; a file of one run only is left out, the last row of a repeated one wins (by ``ord``)."""
    sides = [r.groupBy(key).agg(F.max_by(value, "ord").alias(n)) for r, n in ((base, "base"), (ours, "ours"))]
    return sides[0].join(sides[1], key).withColumn("delta", F.col("ours") - F.col("base"))


def ordered_distinct(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each different value once, at the place of its first row: (key, first)."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
