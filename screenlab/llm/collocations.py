"""Phrases whose words stand together more often than their parts would.

Runs of words are exploded into rows, counted by language, and each phrase is joined with the
counts of its parts. Since a phrase is no more frequent than its parts, rows are only made of
runs that may reach the least count: hashed counts of shorter runs, kept in a bit array of
bounded size, leave the others out beforehand. The bits let too much pass, never too little;
all counts that matter are of the phrases themselves.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, join_frequent, long_rows
from .importance import crc32
from .runs import BLANK, BREAK, WORD, joined, pack, unpack, word_pieces
from .suffixes import _ranges
from .words import _powers, mix, text_buffer

#: Bytes of text in a piece: rows are counted within it before they go on.
PIECE = 1 << 21
#: Bits a frequent run gets, and bits of the array at most (64 MB).
BITS_EACH, BITS_MOST = 16, 1 << 29
#: Bits of a block in which the array is put together.
BLOCK_BITS = 1 << 20
#: Bytes of text for each part in which runs are counted.
PART_BYTES = 1 << 23
#: Parts of a language that are ranked before the language is.
RANK_PARTS = 64
UNKNOWN = "und"


@cache
def _kinds() -> np.ndarray:
    t = np.full(256, WORD)
    t[[0x20, 0x09]] = BLANK
    t[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
    return t


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; ``seed`` tells languages apart."""
    power, inverse = _powers(1 << (len(low) + 1).bit_length())
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + seed)


def _place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash as the part it is counted in and 32 bits within it."""
    return (h >> np.uint64(32)) % np.uint64(parts), h.astype(np.uint32)


def _bit(part: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return mix((part.astype(np.uint64) << np.uint64(32)) | low) & np.uint64(bits - 1)


class Frequent:
    """Bits of the hashed runs of one length that may be frequent."""

    def __init__(self, parts: int, data: bytes) -> None:
        self.parts, self.data = parts, data

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.data, np.uint8)
        at = _bit(*_place(h, self.parts), 8 * len(bits))
        return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _runs(batch: pa.RecordBatch, known: list[Frequent], max_n: int):
    """Of each piece: bytes, starts, ends, and for each n the hash and first word of the runs of n words that ``known`` lets pass.

    known[k] is about runs of k + 1 words; a run passes if both runs of one word less do, and
    what there is about its own length. A run is of the piece in which it ends.
    """
    langs = batch.column("lang").dictionary_encode()
    seeds = np.array([crc32(b, np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(x.encode(), np.uint8) for x in langs.dictionary.to_pylist())], np.uint64)
    seeds = seeds[langs.indices.to_numpy()] * np.uint64(0x9E3779B97F4A7C15)
    data, offsets = text_buffer(batch.column("text"))
    for low, starts, ends, text, stretch, carried in word_pieces(data, offsets, _kinds(), max_n - 1, PIECE):
        word = _hashes(low, starts, ends, seeds[text])
        h, ok, out = word, np.ones(len(word), bool), []
        for n in range(1, max_n + 1):
            if n > 1:  # from first words i: the run of n words is that of n - 1 and one more
                h = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[n - 1 :]) if len(h) > 1 else h[:0]
                ok = ok[:-1] & ok[1:] & (stretch[: len(h)] == stretch[n - 1 :]) if len(ok) > 1 else ok[:0]
            if n <= len(known) and ok.any():
                ok = ok.copy()
                ok[ok] = known[n - 1].has(h[ok])
            first = np.flatnonzero(ok)
            first = first[first + n > carried]
            out.append((h[first], first))
        yield low, starts, ends, text, out


def _frequent(texts: DataFrame, known: list[Frequent], parts: int, least: int) -> Frequent:
    """The bits of the runs of one word more than ``known`` is about."""
    n = len(known) + 1

    def count(batches):
        for batch in batches:
            for *_, out in _runs(batch, known, n):
                h, many = np.unique(out[-1][0], return_counts=True)
                if len(h):
                    part, low = _place(h, parts)
                    yield pack(part, low.view(np.int32), np.minimum(many, 127).astype(np.int8))

    def add(table: pa.Table) -> pa.Table:
        low, many = unpack(table)
        own, index = np.unique(low.view(np.uint32), return_inverse=True)
        own = own[np.bincount(index, many, len(own)) >= least]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "c0": pa.array([own.view(np.int32)], pa.list_(pa.int32()))})

    counted = texts.mapInArrow(count, "part long, c0 array<int>, c1 array<byte>").groupBy("part")
    found = cut(counted.applyInArrow(add, "part long, c0 array<int>"))
    many = found.agg(F.sum(F.size("c0"))).first()[0] or 0
    bits = min(BITS_MOST, max(BLOCK_BITS, 1 << (BITS_EACH * many).bit_length()))

    def place(batches):
        for batch in batches:
            part = np.repeat(batch.column("part").to_numpy(), batch.column("c0").value_lengths().to_numpy())
            at = np.unique(_bit(part, batch.column("c0").flatten().to_numpy().view(np.uint32), bits)).astype(np.int64)
            if len(at):
                yield pack(at // BLOCK_BITS, (at % BLOCK_BITS).astype(np.int32))

    def fill(table: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK_BITS, np.uint8)
        block[unpack(table)[0]] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    data = bytearray(bits // 8)
    blocks = found.mapInArrow(place, "part long, c0 array<int>").groupBy("part").applyInArrow(fill, "part long, bits binary")
    for part, block in blocks.collect():  # BITS_MOST bits at most
        data[part * BLOCK_BITS // 8 : (part + 1) * BLOCK_BITS // 8] = block
    return Frequent(parts, bytes(data))


def exploded(texts: DataFrame, known: list[Frequent], max_n: int) -> DataFrame:
    """(lang, n, phrase, f): rows of runs of words that ``known`` lets pass, counted within pieces."""
    sent = texts.sparkSession.sparkContext.broadcast([(k.parts, k.data) for k in known])

    def explode(batches):
        known = [Frequent(*k) for k in sent.value]
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()
            for low, starts, ends, text, out in _runs(batch, known, max_n):
                text_bytes, to = joined(low, starts, ends)
                size = ends - starts
                check = mix(crc32(low, starts, ends).astype(np.uint64) + (size.astype(np.uint64) << np.uint64(32)))
                for n, (h, first) in enumerate(out, 1):
                    second = check[first]
                    for k in range(1, n):
                        second = mix(second * np.uint64(0xD6E8FEB86659FD93) + check[first + k])
                    order = np.lexsort((second, h))  # 128 bits tell the runs of a piece apart
                    h, second, first = h[order], second[order], first[order]
                    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])))[: len(h)])
                    many, one = np.diff(np.append(at, len(h))), first[at]
                    begin, end = to[one], to[one + n - 1] + size[one + n - 1]
                    phrases = _slices(text_bytes, begin, end)
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_of[text[one]])), pa.array(np.full(len(one), n, np.int32)), phrases, pa.array(many)], ["lang", "n", "phrase", "f"])

    return texts.mapInArrow(explode, "lang string, n int, phrase string, f long")


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin[i]:end[i]]."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    whole = data[_ranges(begin, size)] if len(size) else data[:0]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole))).cast(pa.string())


def word_totals(texts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of each language."""

    def count(batches):
        for batch in batches:
            many = np.zeros(batch.num_rows, np.int64)
            for _, _, _, text, _, _ in word_pieces(*text_buffer(batch.column("text")), _kinds()):
                many += np.bincount(text, minlength=len(many))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(many)], ["lang", "n"])

    return texts.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _words(phrase: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def _with_counts(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase in ``part``; the parts of frequent phrases are frequent, so each has one."""
    uses = cut(cuts.groupBy("lang", part).agg(F.count("*").alias("many")))
    known = uses.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    total = uses.agg(F.sum("many")).first()[0] or 0
    return join_frequent(cuts, cut(known), ["lang", part], "many", total)


def mine(docs: DataFrame, max_n: int = 3, min_count: int = 10, absorb: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (lang, text).

    Texts have A-Z lower-cased and are split at ``.,;:!?`` and line ends into pieces and at
    blanks and tabs into words. A phrase of 2 to ``max_n`` words with ``a`` occurrences of at least
    ``min_count`` has for each cut into parts with l and r occurrences the score
    floor(1000000 * a * a / (l * r)); its lowest cut counts, of equal ones the first. It goes if a
    phrase of one word more that holds it has at least ``absorb`` percent of its count (which is so
    for one of some words more, too, as what lies between is as frequent). A null text is empty,
    a null language ``und``; repeated rows count each; further columns are ignored. Order: score,
    then ``a``, both descending, then the phrase by bytes.
    """
    texts = long_rows(docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(size // PART_BYTES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known: list[Frequent] = []
    for _ in range(max_n):
        known.append(_frequent(texts, known, parts, min_count))
    rows = exploded(texts, known, max_n)
    counts = cut(rows.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    found = counts.where("n > 1")
    k = F.col("k")
    cuts = found.select("lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", F.lit(1), k).alias("left"), _words("phrase", k + 1, F.col("n") - k).alias("right"))
    cuts = _with_counts(_with_counts(cut(cuts), counts, "left", "l"), counts, "right", "r")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).withColumn("below", exact("l") * exact("r"))
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    longer = counts.where("n > 2")
    parts_of = reduce(DataFrame.union, (longer.select("lang", _words("phrase", F.lit(s), F.col("n") - 1).alias("phrase"), "f") for s in (1, 2)))
    over = parts_of.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = low.join(over, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {absorb} * a")
    left = left.select("lang", "phrase", "a", "cut.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    totals = bounded(word_totals(texts))
    return left.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
