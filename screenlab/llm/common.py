"""What the operators share: table access, lineage cuts and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import BROADCAST_BYTES, fixed, shared_folder, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few splits dealt over all cores: such input is small, and its texts are much work.

    For plain scans; to count the partitions of other plans could run parts of them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows in an Arrow batch: a worker holds one batch of texts at a time, and the executor a few.
BATCH_ROWS = 2000


def long_rows(df: DataFrame) -> DataFrame:
    """``df``, and Arrow batches of at most BATCH_ROWS in its session, as its rows hold whole texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


#: ``df`` without its lineage: checkpointed in the shared folder.
cut = fixed


def join_frequent(rows: DataFrame, table: DataFrame, key: list[str], many: str, count: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and in ``many`` how many of ``rows`` have it.

    ``count`` are all rows. Keys of more than a quarter of a partition's share of them are at
    most four times as many as the partitions, so theirs are broadcast; the others are joined
    by a shuffle. So no task meets all rows of a frequent key. No key is null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(100, count // (4 * parts))
    frequent = F.broadcast(table.where(F.col(many) > most).drop(many))
    rest = rows.join(F.broadcast(frequent.select(*key)), key, "left_anti").join(table.where(F.col(many) <= most).drop(many), key)
    return rows.join(frequent, key).unionByName(rest)


def with_least(edges: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """``edges`` with ``m``, the least ``value`` of each ``key``."""
    low = edges.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n_"))  # one shuffle, which both sides read
    return join_frequent(edges, low, [key], "n_", count)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for each id that has an edge.

    Each round hooks every node's current root to the smallest root among its neighbours
    and then shortens the paths, so the rounds grow with the logarithm of the diameter.
    State is one row per node, checkpointed each round; no component meets in one task,
    as only partial minima are shuffled. Loops, repeated edges and an empty table are fine.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = cut(e)
    count = e.count()  # no round has more
    for _ in range(rounds if count else 0):
        # Large star: what is larger than a node hangs on the smallest of its neighbours and itself.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", 2 * count).where("b > a")
        large = cut(large.select(F.least("a", "m").alias("a"), "b").where("a < b").distinct())
        # Small star: a node and its smaller neighbours hang on the smallest of these.
        small = with_least(large, "b", "a", count)
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        new = cut(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        # A forest of stars stays as it is: no centre is a leaf and no leaf has two centres.
        leaf = new.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.lit(0).alias("c"))
        seen = leaf.union(new.select(F.col("a").alias("id")).distinct().select("id", F.lit(0).cast("long"), F.lit(1)))
        open_ = seen.groupBy("id").agg(F.sum("n").alias("n"), F.max("c").alias("c")).where("n > 1 or (n > 0 and c = 1)")
        e = new
        if open_.isEmpty():
            break
    else:
        if count:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
    found = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.union(e.select("a").distinct().select("a", "a"))


def written(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the folder of spark.checkpoint.dir, read again, and the table's path; the table ``before``, of which it was made, is dropped."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table and read again; the shuffle files it was made of go at once, as nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df)[0]
    finally:
        conf.set(key, before)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, checkpointed, with a broadcast hint if its values take at most ``most`` bytes; else joins shuffle it."""
    return small(cut(df), most)


def same_text(docs: str, found: str) -> Column:
    """Rows of ``docs`` (doc_id, text) that ``found`` (doc_id, text_hash) names, nulls included; both are aliases."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{found}.doc_id")) & F.xxhash64(f"{docs}.text").eqNullSafe(F.col(f"{found}.text_hash"))
