"""A corpus pipeline: each stage reads what the one before kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm import bpe, decontaminate, jaccard, quality, secret_scan
from screenlab.llm.common import bounded, cut, join_frequent, same_text, table, written
from screenlab.llm.queries import tokenizer_path

#: No SQL: the quality model is fitted and the spans of secrets are linked by code.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut. Null and empty texts are scored like others, repeated rows each; of no documents none stays."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = "score_" + "".join(docs.columns)  # clashes with no column
    return quality.scored(docs, model, out=name).where(F.col(name) >= quality.CUT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id, and of its texts that of the least hash. Of repeated rows, one stays.

    Texts without words and rows of a null doc_id stay.
    """
    found = jaccard.join(docs.select("doc_id", "text"), parts_of=True, all_links=False)
    found = cut(found.where("part is not null and n_links > 0").select("doc_id", "text_hash", "part").distinct())
    first = cut(found.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("many")))
    rest = join_frequent(found, first, ["part"], "many", found.count())
    gone = bounded(rest.where(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash"))
    left = docs.alias("d").join(gone.alias("g"), same_text("d", "g"), "left_anti")
    again = bounded(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left.select(*docs.columns)
    rest = left.join(again, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.select(*docs.columns).union(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows.

    Null and empty texts have no words and stay; repeated rows are judged alike. An empty
    benchmark takes nothing away.
    """
    found = decontaminate.search(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    gone = bounded(found.where(decontaminate.contaminated()).select("doc_id", "text_hash").distinct())
    return docs.alias("d").join(gone.alias("g"), same_text("d", "g"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by the name of its kind and n_chars counted again.

    Null and empty texts stay as they are, repeated rows are masked alike, and of a doc_id
    with several texts each is masked by its own spans.
    """
    found = secret_scan.scan(docs.select("doc_id", "text")).where("size(spans) > 0").select("doc_id", "text_hash", "spans").distinct()
    found = bounded(found)
    clean = docs.alias("d").join(found.alias("s"), same_text("d", "s"), "left_anti")
    name = "spans_" + "".join(docs.columns)  # clashes with no column
    masked = docs.alias("d").join(found.alias("s"), same_text("d", "s")).select("d.*", F.col("s.spans").alias(name))
    masked = masked.withColumn("text", F.pandas_udf(secret_scan.redact, "string")("text", name)).drop(name)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.union(masked)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, repeated rows each; null and empty texts have no ids."""
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer_path(), keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, before=path)
    return docs
