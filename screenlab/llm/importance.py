"""Importance resampling towards a target set, by hashed word runs.

Every feature (a run of words) falls into a bucket; a bucket's gain is the logarithm of how
much likelier it is in the target. The gains are one array, so a document's weight is a
mean over array entries. Weights with Gumbel noise are drawn without replacement by taking
the highest scores: each partition's eligible rows become a sorted run, runs meet range by
range, and a tournament tree merges the runs of a range until the draw is complete.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, long_rows
from .runs import BLANK, WORD, joined, word_pieces
from .words import _lower, text_buffer

#: Entries that a run hands over at a time, and rows of a range at least.
CHUNK, RANGE_ROWS = 1024, 4096
#: Ranges of a draw at most; each has whole scores.
RANGES = 1 << 16


@cache
def _crc_table() -> np.ndarray:
    """Of each byte: eight steps of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[starts[i]:ends[i]], a byte of all at a time; long ones by themselves."""
    size = ends - starts
    order = np.argsort(np.minimum(size, 65).astype(np.uint8), kind="stable")[::-1]
    at, size, table = starts[order], size[order], _crc_table()
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-np.minimum(size, 65), -np.arange(64), "left")  # how many have a byte k
    for k in range(int(min(size[0], 64)) if len(size) else 0):
        m = longer[k]
        c = crc[:m]
        crc[:m] = table[(c ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -64, "left"))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


@cache
def _kinds() -> np.ndarray:
    return np.where(_lower() == 0, BLANK, WORD)


def features(data: np.ndarray, offsets: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, crc32, whether it is a single word) of all runs of 1 to ``max_n`` words, piece by piece."""
    for low, starts, ends, text, _, carried in word_pieces(data, offsets, _kinds(), max_n - 1):
        if max_n == 1:
            yield text, crc32(low, starts, ends), np.ones(len(text), bool)
            continue
        words, to = joined(low, starts, ends)
        for n in range(1, max_n + 1):
            last = np.arange(max(n - 1, carried), len(text))
            last = last[text[last - n + 1] == text[last]]
            yield text[last], crc32(words, to[last - n + 1], to[last] + (ends - starts)[last]), np.full(len(last), n == 1)


def bucket_counts(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of ``docs`` (text) fall into each bucket that has any."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, h, _ in features(*text_buffer(batch.column("text")), max_n):
                total += np.bincount(h % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Of each bucket: thousandths of the log ratio of its smoothed shares in ``target`` and ``docs``, floored. A table has at most ``buckets`` rows here."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, texts in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(texts.select("text"), max_n, buckets).collect():
            out[bucket] = n
    a, b = (s.sum() + buckets), (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((y + 1) * a / ((x + 1) * b))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; weight is the floored mean gain, 0 without features."""

    def weigh(batches):
        for batch in batches:
            total, many, words = np.zeros((3, batch.num_rows), np.int64)
            for text, h, single in features(*text_buffer(batch.column("text")), max_n):
                np.add.at(total, text, gain[h % np.uint32(len(gain))])
                many += np.bincount(text, minlength=len(many))
                words += np.bincount(text[single], minlength=len(many))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """``weights`` with ``score``: the weight and Gumbel noise, in thousandths, drawn from seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise)


class Tournament:
    """A tree of matches between runs; the winner is the run whose next entry is the least."""

    def __init__(self) -> None:
        self.leaves, self.size, self.keys, self.tree = {}, 1, [None], [0, 0]

    def _play(self, leaf: int) -> None:
        keys, tree = self.keys, self.tree
        node = (leaf + self.size) >> 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            x, y = keys[a], keys[b]
            tree[node] = a if y is None or (x is not None and x <= y) else b
            node >>= 1

    def put(self, run: int, key: tuple | None) -> None:
        """The run's next entry, None once it has none."""
        leaf = self.leaves.setdefault(run, len(self.leaves))
        if leaf == self.size:  # twice as many places; all matches again
            self.keys += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                a, b = self.tree[2 * node], self.tree[2 * node + 1]
                x, y = self.keys[a], self.keys[b]
                self.tree[node] = a if y is None or (x is not None and x <= y) else b
        if len(self.tree) == 2:
            self.tree = [0, 0]
        self.keys[leaf] = key
        self._play(leaf)

    def least(self) -> tuple | None:
        return self.keys[self.tree[1]]


RUN_ROWS = "part int, run int, first struct<score:long,none:int,doc_id:long,n:long>, entries array<struct<score:long,none:int,doc_id:long,n_features:long,weight:long,many:long>>"
DRAWN = "doc_id long, n_features long, weight long, score long, rank long"


def _key(e: dict) -> tuple:
    return e["score"], e["none"], e["doc_id"], e["n_features"]


def runs(rows: DataFrame, lows: list[int]) -> DataFrame:
    """Each partition's rows as a sorted run, in chunks of one range each; equal rows are one entry.

    Scores are negated, so less is better; range p holds those up to -lows[p] beyond the range before.
    """
    highs = [-x for x in lows]

    def chunk(batches):
        run, open_, part, last = TaskContext.get().partitionId(), [], 0, None
        pack = lambda: {"part": part, "run": run, "first": {"score": open_[0]["score"], "none": open_[0]["none"], "doc_id": open_[0]["doc_id"], "n": open_[0]["n_features"]}, "entries": open_}
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                key, p = _key(e), bisect_left(highs, e["score"])
                if open_ and p == part and key == last:
                    open_[-1]["many"] += 1
                    continue
                if open_ and (p != part or len(open_) >= CHUNK):
                    out.append(pack())
                    open_ = []
                part, last = p, key
                open_.append(e | {"many": 1})
            if out:
                yield pa.RecordBatch.from_pylist(out, _RUN_SCHEMA)
        if open_:
            yield pa.RecordBatch.from_pylist([pack()], _RUN_SCHEMA)

    entries = rows.select((-F.col("score")).alias("score"), F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features", "weight")
    return entries.sortWithinPartitions("score", "none", "doc_id", "n_features").mapInArrow(chunk, RUN_ROWS)


_KEY = [("score", pa.int64()), ("none", pa.int32()), ("doc_id", pa.int64())]
_RUN_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("first", pa.struct([*_KEY, ("n", pa.int64())])), ("entries", pa.list_(pa.struct([*_KEY, ("n_features", pa.int64()), ("weight", pa.int64()), ("many", pa.int64())])))])
_DRAWN_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_features", "weight", "score", "rank")])


def merged(chunks: DataFrame, above: list[int], count: int) -> DataFrame:
    """All rows of the ranges; the first ``count`` with their ranks. ``above``: rows before each range.

    A task reads the chunks of its ranges in the order of their first entries, the order in
    which the merge needs them, so a run has few chunks in memory, however long it is.
    """

    def merge(batches):
        out: list[dict] = []
        tree, queues, part, rank = Tournament(), {}, None, 0

        def emit(e):
            nonlocal rank
            for _ in range(e["many"]):
                rank += 1
                out.append({"doc_id": None if e["none"] else e["doc_id"], "n_features": e["n_features"], "weight": e["weight"], "score": -e["score"], "rank": rank if rank <= count else None})

        def until(key):
            """Emits what comes before ``key``; with the draw complete, in any order."""
            while (least := tree.least()) is not None and (key is None or least[0] < key):
                run = least[1]
                queue = queues[run]
                emit(queue.popleft())
                if rank >= count:
                    for q in queues.values():
                        while q:
                            emit(q.popleft())
                    for r in queues:
                        tree.put(r, None)
                    return
                tree.put(run, (_key(queue[0]), run) if queue else None)

        for batch in batches:
            for x in batch.to_pylist():
                if x["part"] != part:
                    until(None)
                    tree, queues, part, rank = Tournament(), {}, x["part"], above[x["part"]]
                until((*x["first"].values(),))
                if rank >= count:  # complete: nothing is ordered any more
                    for e in x["entries"]:
                        emit(e)
                else:
                    queue = queues.setdefault(x["run"], deque())
                    queue.extend(x["entries"])
                    tree.put(x["run"], (_key(queue[0]), x["run"]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, _DRAWN_SCHEMA)
                    out.clear()
        until(None)
        yield pa.RecordBatch.from_pylist(out, _DRAWN_SCHEMA)

    dealt = chunks.repartition("part").sortWithinPartitions("part", "first")
    return dealt.mapInArrow(merge, DRAWN)


def draw(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the highest scores of the rows of ``min_words`` words and more are drawn.

    floor(percent * N / 100) of the N eligible rows get ranks from 1 on; ties go to the smaller
    doc_id, then to the row of fewer features, and null ids come last. Rows are what ``scored``
    gives. Only ranges of scores that the draw reaches are sorted and shuffled.
    """
    rows = cut(rows.select("doc_id", "n_words", "n_features", "weight", "score"))
    may = rows.where(F.col("n_words") >= min_words)
    # Scores are thousandths of logarithms of counts: some hundred thousand values at most, whatever the rows.
    tally = sorted(((r[0], r[1]) for r in may.groupBy("score").count().collect()), reverse=True)
    total = sum(n for _, n in tally)
    count = percent * total // 100
    lows, above, seen, size = [], [], 0, 0
    for score, n in tally:
        if seen >= count:
            break
        if not size:
            above.append(seen)
        seen, size = seen + n, size + n
        if size >= max(RANGE_ROWS, count // RANGES) or seen >= count:
            lows, size = [*lows, score], 0
    out = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"), "n_words")
    if not lows:
        return out.drop("n_words")
    low = lows[-1]
    ranked = merged(runs(may.where(F.col("score") >= low), lows), above, count)
    return out.where(~((F.col("n_words") >= min_words) & (F.col("score") >= low))).drop("n_words").unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20) -> DataFrame:
    """``draw`` for ``docs`` (doc_id, text) towards ``target`` (text).

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of all beyond ASCII. Null
    and empty texts have no features and weight 0; repeated rows are drawn each, side by side.
    Further columns are ignored; of an empty table nothing is drawn, and an empty target
    leaves the smoothed shares. ``doc_id`` is an integer.
    """
    docs = long_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gain = gains(docs, target, max_n, buckets)
    return draw(scored(weighed(docs, gain, max_n), seed), percent, min_words)
