"""Secret scans: strong patterns everywhere, weak parts only where complementary ones are near."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, long_rows
from .words import text_buffer

#: Kinds in the order that ties in start take: base patterns, then what linking adds.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ID, SECRET, ENDPOINT = 3, 4, 5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: named identifiers, long mixed tokens and service addresses prove nothing alone.
WEAK_ID = re.compile(r"""(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{4,})""", re.I | re.A)
WEAK_ID_WORDS = ("client", "access", "account", "user", "login")
#: A token begins where a run of its characters does, after '=' too: KEY=VALUE; padding goes to the token before it.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", re.A)
ADDRESS = re.compile(r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", re.I | re.A)
#: A run of these of at least RUN bytes is in every access, hex and weak secret match.
RUN = 20
TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True

PARTS = "array<struct<kind:int,start:long,end:long>>"


def long_runs(column: pa.Array) -> np.ndarray:
    """Which texts have a run of RUN token characters."""
    data, offsets = text_buffer(column)
    inside = np.concatenate(([False], TOKEN[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    at = starts[ends - starts >= RUN]
    has = np.zeros(len(offsets), bool)
    has[np.searchsorted(offsets, at, "right") - 1] = True  # a run over a text's end only adds one to look at
    late = ends[ends - starts >= RUN] - 1
    has[np.searchsorted(offsets, late, "right") - 1] = True
    for s, e in zip(at[late - at > RUN], late[late - at > RUN], strict=True):  # or one that covers whole texts
        i, j = np.searchsorted(offsets, (s, e), "right") - 1
        has[i : j + 1] = True
    return has[:-1]


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def matches(text: str, runs: bool) -> tuple[list, list]:
    """(kind, start, end) of the base matches, and of weak parts outside these, in code points."""
    low = text.lower()
    base, weak = [], []
    if any(w in low for w in ASSIGN_WORDS):
        base += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if runs:
        base += [(1, *m.span()) for m in ACCESS.finditer(text)]
        base += [(2, *m.span()) for m in HEX.finditer(text)]
        weak += [(SECRET, *m.span()) for m in WEAK_SECRET.finditer(text) if mixed(m[0])]
    if any(w in low for w in WEAK_ID_WORDS):
        weak += [(ID, *m.span(1)) for m in WEAK_ID.finditer(text)]
    if "://" in text:
        weak += [(ENDPOINT, *m.span()) for m in ADDRESS.finditer(text)]
    base.sort(key=lambda x: (x[1], x[0]))
    if base and weak:
        starts, most = [b[1] for b in base], np.maximum.accumulate([b[2] for b in base])
        weak = [w for w in weak if (i := int(np.searchsorted(starts, w[2], "left"))) == 0 or most[i - 1] <= w[1]]
    return base, weak


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, weak) of each row; nothing of the texts but the spans."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            column = batch.column("text")
            runs = long_runs(column)
            both = [matches(t or "", r) for t, r in zip(column.to_pylist(), runs.tolist(), strict=True)]
            rows = lambda k: pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in x[k]] for x in both], kind)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), rows(0), rows(1)], names=["doc_id", "text_hash", "base", "weak"])

    return long_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, base {PARTS}, weak {PARTS}")


def link(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, text_hash, added): the weak parts that have their complements within ``scope`` characters.

    An interval join in cells of ``scope`` characters: each part meets, for each role, the
    extremes of its own cell and the two beside it. These tell exactly whether a complement
    is near enough, so no pair of parts is made however many a text has.
    An identifier needs a secret, a secret needs an identifier, an endpoint needs both.
    """
    role = F.when(F.col("p.kind").isin(1, ID), "id").when(F.col("p.kind").isin(0, 2, SECRET), "secret").otherwise("endpoint")
    some = found.where((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    parts = some.distinct().select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("p")).select("doc_id", "text_hash", "p", role.alias("role"), F.floor(F.col("p.start") / scope).alias("cell"), F.floor((F.col("p.end") - 1) / scope).alias("last"))
    need = parts.where(F.col("p.kind") >= ID)
    spans = parts.where("role <> 'endpoint'").select("doc_id", "text_hash", "role", "p", F.explode(F.sequence("cell", "last")).alias("cell"))
    cells = spans.groupBy("doc_id", "text_hash", "cell", "role").agg(F.min("p.start").alias("low"), F.max("p.end").alias("high"))
    asks = need.select("doc_id", "text_hash", "p", F.col("role").alias("own"), F.explode(F.sequence(F.col("cell") - 1, F.col("last") + 1)).alias("cell"))
    on = F.col("a.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("c.text_hash")) & (F.col("a.cell") == F.col("c.cell"))
    near = asks.alias("a").join(cells.alias("c"), on).where((F.col("low") < F.col("p.end") + scope) & (F.col("high") > F.col("p.start") - scope) & (F.col("role") != F.col("own")))
    near = near.groupBy("a.doc_id", "a.text_hash", "p", "own").agg(F.max((F.col("role") == "id").cast("int")).alias("i"), F.max((F.col("role") == "secret").cast("int")).alias("s"))
    ok = near.where(((F.col("own") == "id") & (F.col("s") == 1)) | ((F.col("own") == "secret") & (F.col("i") == 1)) | ((F.col("own") == "endpoint") & (F.col("i") + F.col("s") == 2)))
    return ok.groupBy("doc_id", "text_hash").agg(F.collect_list("p").alias("added"))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, text_hash, base, spans) for each row of ``docs`` (doc_id, text).

    ``base`` are the strong matches, ``spans`` these and the linked weak parts, as
    array<struct<kind, start, end>> in code points, end exclusive, by start and kind; kind
    indexes KINDS. Null and empty texts have none; repeated rows stay repeated; other
    columns are ignored. Spans of one text are the only thing that meets in one row.
    """
    found = cut(find(docs))
    added = link(found, scope)
    on = F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("f.text_hash").eqNullSafe(F.col("l.text_hash"))
    some = found.where("size(weak) > 0").alias("f").join(added.alias("l"), on, "left")
    some = some.select("f.doc_id", "f.text_hash", "f.base", F.concat("f.base", F.coalesce("l.added", F.array().cast(PARTS))).alias("spans"))
    done = some.union(found.where("size(weak) = 0").select("doc_id", "text_hash", "base", F.col("base").alias("spans")))
    by = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return done.withColumn("spans", F.transform(F.array_sort(by), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text with each span, or overlapping spans, replaced by the name of the first kind; for a pandas UDF."""
    return pd.Series([redacted(t, s) for t, s in zip(texts, spans, strict=True)])


def redacted(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at, i = [], 0, 0
    found = [(int(s["start"]), int(s["end"]), s["kind"]) for s in spans]
    while i < len(found):
        start, end, kind = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][1])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]
