"""Readers; paths go to Spark's own sources, so any file system that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..operators.relate import small
from . import schema
from .archives import archive_entries, is_image_entry  # noqa: F401

MODES = {"skip": "PERMISSIVE", "strict": "FAILFAST", "tolerant": "DROPMALFORMED"}


def labels(spark: SparkSession, paths: str | list[str], mode: str = "skip", columns: str = schema.LABELS) -> DataFrame:
    """Label lines, blank ones skipped; ``strict`` fails on a malformed line, ``tolerant`` drops it."""
    return spark.read.schema(columns).option("mode", MODES[mode]).json(paths)


def labels_with_rest(spark: SparkSession, paths: str | list[str], columns: str = schema.LABELS) -> DataFrame:
    """Labels and the line itself as ``json``, so that unknown keys survive a rewrite."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(F.from_json("value", columns).alias("r"), F.col("value").alias("json")).select("r.*", "json")


def chunks(spark: SparkSession, paths: list[str], mode: str = "skip") -> DataFrame:
    """Label files in the order given (globs allowed), with ``src_ord``, ``source`` and ``line_ord``."""
    out = None
    for k, p in enumerate(paths):
        part = ordered_lines(spark, p).select(F.from_json("value", schema.LABELS, {"mode": "FAILFAST" if mode == "strict" else "PERMISSIVE"}).alias("r"), "source", "line_ord").select("r.*", "source", "line_ord", F.lit(k).alias("src_ord"))
        out = part if out is None else out.union(part)
    if out is None:
        raise FileNotFoundError("no label source")
    return out


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source, line_ord): lines that are not blank; the order is that of files, blocks and lines."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.where(F.trim("value") != "").select("value", "source", F.struct("source", "block", "at").alias("line_ord"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, asked of Spark's file system."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path(p).getFileSystem(hadoop).globStatus(path(p))]


def chunk_files(spark: SparkSession, folder: str, seed: str | None = None) -> list[str]:
    """The label files of the seed folder, if any, and of the folders chunk_* in order of their names; folders without labels are left out."""
    found = [f"{seed}/labels.jsonl"] if seed and existing(spark, [f"{seed}/labels.jsonl"]) else []
    hadoop, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunk_*/labels.jsonl")
    found += sorted(str(f.getPath().toString()) for f in path.getFileSystem(hadoop).globStatus(path) or [])
    if not found:
        raise FileNotFoundError(f"no labels in {folder}")
    return found


def manifest_or_folder(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a folder (its labels.jsonl, image paths relative to it) or of a manifest file (relative to the project)."""
    rows = labels(spark, f"{path}/labels.jsonl" if not path.endswith((".jsonl", ".json")) else path)
    return rows if path.endswith((".jsonl", ".json")) else rows.withColumn("image_path", F.concat(F.lit(f"{path}/"), "image_path"))


def rejected(spark: SparkSession, paths: str | list[str], columns: str = schema.LABELS) -> int:
    """S3: how many lines, blank ones aside, are malformed."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{columns}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r._bad is not null").count()


def tagged_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files [<tag>_]raw|preprocessed_results.jsonl, with ``tag`` and ``mode``."""
    name = F.col("_metadata.file_name")
    rows = spark.read.schema(schema.RESULTS).option("mode", "FAILFAST").option("pathGlobFilter", "*_results.jsonl").json(folder)
    return rows.select("*", F.regexp_extract(name, r"^(?:(.*)_)?(raw|preprocessed)_results\.jsonl$", 1).alias("tag"), F.regexp_extract(name, r"^(?:.*_)?(raw|preprocessed)_results\.jsonl$", 1).alias("mode"))


def images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images (BGR bytes) by Spark's image source; unreadable ones are dropped on demand."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")


def listing(spark: SparkSession, path: str, pattern: str = "*.png", first: int = 0) -> DataFrame:
    """Sorted file paths, contents unread."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length").orderBy("path")
    return found.limit(first) if first else found


def charset(spark: SparkSession, path: str, with_space: bool = False) -> DataFrame:
    """The characters of a dictionary file; other line separators than the line end split too."""
    chars = spark.read.text(path).select(F.explode(F.split("value", "[\x0b\x0c\r\x1c-\x1e\x85  ]", -1)).alias("ch")).where("ch <> ''")
    return chars.union(spark.createDataFrame([(" ",), ("\n",)], "ch string")).distinct() if with_space else chars


def detection_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly two fields, the second parsed."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(parts) == 2)
    return rows.select(parts[0].alias("image_path"), F.from_json(parts[1], schema.POLYGONS).alias("polygons"))


def metric_hits(line: Column) -> Column:
    """All values of a log line: (named, plain), those of lines that name the current metric, and those of any line."""
    numbers = lambda pattern: F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), lambda x: x.try_cast("double"))
    found = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<double>"))
    return F.struct(found(numbers(r"cur metric,.*?hmean:\s*([0-9.]+)")).alias("named"), found(numbers(r"hmean\s*:\s*([0-9.]+)")).alias("plain"))


def metric_values(lines: DataFrame, *order: str, source: str | None = None) -> DataFrame:
    """``lines`` (value) with (seq, hmean), a row for each value of a log, ``seq`` being its place in the line.

    Values of lines that name the current metric count; only a log (all lines, or those of one
    ``source``) without any gives those of its other lines. A number that begins on the next line
    is not seen. Further columns stay; ``order`` names those to keep if not all.
    """
    keep = [*order, *([source] if source else [])] or lines.columns
    hit = lines.select(*keep, metric_hits(F.col("value")).alias("_hits")).where("size(_hits.plain) > 0 or size(_hits.named) > 0")
    has = F.coalesce(F.bool_or(F.size("_hits.named") > 0), F.lit(False)).alias("_named")
    if source:
        told = small(hit.groupBy(source).agg(has))
        hit = hit.alias("h").join(told.alias("t"), F.col(f"h.{source}").eqNullSafe(F.col(f"t.{source}"))).select("h.*", "t._named")
    else:
        hit = hit.crossJoin(F.broadcast(hit.agg(has)))  # one row
    return hit.select(*keep, F.posexplode(F.when(F.col("_named"), F.col("_hits.named")).otherwise(F.col("_hits.plain"))).alias("seq", "hmean"))


def line_count(spark: SparkSession, path: str) -> int:
    """S19."""
    return spark.read.text(path).count()


def truth(rows: DataFrame) -> DataFrame:
    """Image path and true text of either record form."""
    text = F.when(F.col("elements").isNull(), F.coalesce("text", F.lit(""))).otherwise(geometry.truth_of(F.col("elements")))
    return rows.withColumn("truth", text).withColumn("image_path", F.coalesce("image_path", "image"))


def with_ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """A row number within a file, for the ties of later sorts."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
