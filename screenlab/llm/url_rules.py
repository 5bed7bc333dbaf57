"""URL filters: expressions of each URL meet the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rule text up to which the rules are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8_000_000


def rest_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3))


def host_of(url: Column) -> Column:
    rest = rest_of(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = rest_of(url)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


#: Of the shapes that a URL has room for: the host suffix with its path lengths, then the digest of each expression.
SUFFIXES = "transform(filter(shapes, s -> s.labels <= size(split(host, '[.]'))), s -> struct(substring_index(host, '.', -s.labels) AS host, filter(s.lengths, k -> k <= length(path)) AS lengths))"
EXPRESSIONS = "flatten(transform(hosts, s -> transform(s.lengths, k -> sha2(concat(length(s.host), ':', s.host, substring(path, 1, k)), 256))))"


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """Verdict of ``rules`` (host, path, verdict) for each row of ``pages`` (page_id, url).

    A rule fits its host and every subdomain, when the URL's path starts with the rule's.
    Each URL is expanded into the host suffixes and path prefixes of the shapes (labels in
    the host, characters in the path) that occur among the rules; expressions meet rules on
    the first ``prefix_chars`` hex digits of a SHA-256, and the whole digest confirms. The shapes
    are one broadcast row of two numbers each, so lists of thousands of shapes plan like short ones.
    The longest rule (host plus path) wins, then the longer host, then ``block``.

    Null URLs and those without "://" have an empty host and path and get the default.
    Repeated rules count once, repeated pages give repeated rows, other columns of either
    table are ignored. Empty tables give an empty result, or the default for every page.
    Rules are broadcast while their text stays under BROADCAST_BYTES, else shuffled on the
    hash prefix, whose only hot values are those of the rules' own expressions.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_verdict is not null").distinct()
    shaped = rules.withColumn("labels", F.size(F.split("r_host", r"\."))).withColumn("chars", F.length("r_path"))
    # One row in all: the depths of hosts, each with the lengths of its paths.
    shapes = shaped.groupBy("labels").agg(F.collect_set("chars").alias("lengths")).agg(F.collect_list(F.struct("labels", "lengths")).alias("shapes"))
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, prefix_chars))
    n_bytes = rules.agg(F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path")), F.lit(0))).first()[0]
    if n_bytes <= BROADCAST_BYTES:
        rules = F.broadcast(rules)

    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    # Only rows that some rule fits are aggregated; equal rows have one result, so pages need no numbers.
    asked = base.where("host <> ''").crossJoin(F.broadcast(shapes)).withColumn("hosts", F.expr(SUFFIXES))
    keys = asked.select("page_id", "host", "path", F.explode(F.expr(EXPRESSIONS)).alias("digest")).withColumn("short", F.substring("digest", 1, prefix_chars))
    hit = keys.join(rules, "short").where("digest = r_digest")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hit.groupBy("page_id", "host", "path").agg(F.max(rank).alias("best"))
    j = base.alias("p").join(best.alias("b"), (F.col("p.page_id").eqNullSafe(F.col("b.page_id"))) & (F.col("p.host") == F.col("b.host")) & (F.col("p.path") == F.col("b.path")), "left")
    return j.select("p.page_id", "p.host", "p.path", F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))
