"""Benchmark decontamination with an FM-index of each shard of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, long_rows
from .words import blocks, hash_words, text_buffer

#: Bytes of benchmark text sent to the executors at once; a larger benchmark is taken in blocks.
BENCHMARK_BYTES = 16_000_000
#: Words of a shard, which has an index of its own, and bytes of texts held at a time. Only runs of benchmark words are indexed.
SHARD_WORDS, HELD_BYTES = 1_000_000, 32_000_000
#: Every so manieth suffix position is kept for locating.
SAMPLE = 16
#: The words of ``words``, as a pattern, and what lower-cases their A-Z.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Phrases:
    """The benchmark's words as numbers, one item after another, and its windows as places in these."""

    hashes: np.ndarray  # of the different words, ascending; a word's number is its index + 1
    names: list[str]  # the words themselves, in that order
    twins: dict[str, int]  # numbers of the words that share their hash with others
    stream: np.ndarray  # the numbers of all words
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: where each begins in the stream, its item
    items: list[str]
    filter: np.ndarray  # a bit for the low bits of each hash

    @property
    def lengths(self) -> tuple[int, int]:
        return min(self.windows, default=1), max(self.windows, default=1)


def phrases(texts: list[tuple[str, str]], n: int) -> Phrases:
    """Of (item, text) rows; about 12 bytes for each word, besides the different words."""
    items = sorted({i for i, _ in texts})
    number = {x: k for k, x in enumerate(items)}
    data, offsets = text_buffer(pa.array([t for _, t in texts], pa.string()))
    h, first = hash_words(data, offsets)
    own = np.unique(h)
    stream = (np.searchsorted(own, h) + 1).astype(np.int32)
    names, others = [""] * len(own), {}
    found: dict[int, tuple[list, list]] = {}
    for k, (item, text) in enumerate(texts):
        words, ids = [w.translate(LOWER) for w in WORD.findall(text)], stream[first[k] : first[k + 1]].tolist()
        for at, (w, i) in enumerate(zip(words, ids, strict=True), int(first[k])):
            if not names[i - 1]:
                names[i - 1] = w
            elif names[i - 1] != w:
                others.setdefault((i, w), []).append(at)
        if words:
            size = min(n, len(words))
            begins, of = found.setdefault(size, ([], []))
            begins.append(np.arange(first[k], first[k + 1] - size + 1, dtype=np.int32))
            of.append(np.full(len(begins[-1]), number[item], np.int32))
    windows = {size: (np.concatenate(begins), np.concatenate(of)) for size, (begins, of) in found.items()}
    own, names, twins = numbered_apart(own, names, stream, others)
    bits = np.zeros(1 << min(24, max(10, (64 * len(own)).bit_length())), bool)
    bits[own & np.uint64(len(bits) - 1)] = True
    return Phrases(own, names, twins, stream, windows, items, bits)


def numbered_apart(hashes: np.ndarray, names: list[str], stream: np.ndarray, others: dict[tuple[int, str], list[int]]) -> tuple[np.ndarray, list[str], dict[str, int]]:
    """Hashes, names and twins when ``others``, (number, word) with places in the stream, get numbers of their own beside the word that has their hash; the stream is changed to these."""
    if not others:
        return hashes, names, {}
    more = np.bincount([i for i, _ in others], minlength=len(hashes) + 1)
    begin = np.arange(len(hashes) + 1) + np.cumsum(more) - more
    stream[:] = begin[stream]
    named, twins, n = [""] * (len(hashes) + len(others)), {}, begin.copy()
    for i, w in enumerate(names, 1):
        named[begin[i] - 1] = w
        if more[i]:
            twins[w] = int(begin[i])
    for (i, w), places in sorted(others.items()):
        n[i] += 1
        named[n[i] - 1], twins[w], stream[places] = w, int(n[i]), n[i]
    return np.repeat(hashes, 1 + more[1:]), named, twins


class Wavelet:
    """Wavelet matrix of a sequence of numbers: access and rank for whole arrays of queries."""

    def __init__(self, s: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.ones, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (s >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        low = np.zeros_like(i)
        for k in range(self.bits):
            one = ((c >> (self.bits - 1 - k)) & 1) == 1
            a, b = self.ones[k][low], self.ones[k][i]
            low, i = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for k in range(self.bits):
            a = self.ones[k][i]
            one = self.ones[k][i + 1] - a
            c = c * 2 + one
            i = np.where(one == 1, self.zeros[k] + a, i - a)
        return c


class Index:
    """FM-index of a sequence of word numbers (0 between runs)."""

    def __init__(self, s: np.ndarray, most: int):
        s = np.append(s, -1) + 1  # the end sorts first
        n = len(s)
        # Suffixes sorted by doubling the compared length until all differ.
        rank, step = s.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (max(n, most + 2) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
        self.n = n
        self.text = Wavelet(s[order - 1], most + 1)
        self.count = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=most + 2))))
        self.marked = order % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(self.marked)))
        self.kept = order[self.marked]

    def search(self, stream: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each window of ``size`` words of the stream, backwards from its last word."""
        low, high = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        there = np.diff(self.count) > 0  # most windows of a large benchmark have a word that the shard lacks
        open_ = np.arange(len(begins))
        for k in range(size):
            open_ = open_[there[stream[begins[open_] + k] + 1]]
        high[open_] = self.n
        for k in range(size - 1, -1, -1):
            c = stream[begins[open_] + k].astype(np.int64) + 1
            low[open_] = self.count[c] + self.text.rank(c, low[open_])
            high[open_] = self.count[c] + self.text.rank(c, high[open_])
            open_ = open_[low[open_] < high[open_]]
            if not len(open_):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back to the nearest sampled one."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            got = self.marked[rows[open_]]
            done = open_[got]
            out[done] = self.kept[self.marks[rows[done]]] + steps
            open_ = open_[~got]
            c = self.text.access(rows[open_])
            rows[open_] = self.count[c] + self.text.rank(c, rows[open_])
            steps += 1
        return out


def known_runs(p: Phrases, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, word number) of the words that lie in runs of benchmark words long enough for a window."""
    at = np.flatnonzero(p.filter[h & np.uint64(len(p.filter) - 1)])
    i = np.minimum(np.searchsorted(p.hashes, h[at]), len(p.hashes) - 1)
    ok = p.hashes[i] == h[at]
    at, number = at[ok], i[ok] + 1
    text = np.searchsorted(first, at, "right")
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(text) != 0)))) if len(at) else at
    size = np.diff(np.append(new, len(at)))
    keep = np.repeat(size >= p.lengths[0], size)
    return at[keep], number[keep]


def known(p: Phrases, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, and text, word index and number of its words in runs of benchmark words."""
    data, offsets = text_buffer(column)
    words, found = np.zeros(len(offsets) - 1, np.int64), [np.zeros((3, 0), np.int64)]
    for i, j in blocks(offsets):
        h, first = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        words[i:j] = np.diff(first)
        if p.windows:
            at, number = known_runs(p, h, first)
            d = np.searchsorted(first, at, "right") - 1
            found.append(np.stack([d + i, at - first[d], number]))
    return words, *np.concatenate(found, axis=1)


def occurrences(p: Phrases, doc: np.ndarray, where: np.ndarray, number: np.ndarray, shard: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are inside a window's occurrence, and the different (text, item) of the occurrences.

    The words are indexed a shard of ``shard`` words at a time; a shard goes on into the next one by the longest
    window less a word.
    """
    hit, pairs = np.zeros(len(where), bool), [np.zeros((0, 2), np.int64)]
    if not len(where):
        return hit, pairs[0]
    # The runs one after another, 0 before each.
    new = np.concatenate(([True], (np.diff(where) != 1) | (np.diff(doc) != 0)))
    place = np.arange(len(where)) + np.cumsum(new)
    s = np.zeros(int(place[-1]) + 1, np.int32)
    s[place] = number
    back = np.full(len(s), -1)
    back[place] = np.arange(len(where))
    cover = np.zeros(len(s) + 1, np.int64)
    for t in range(0, len(s), shard):
        index = Index(s[t : t + shard + p.lengths[1] - 1], len(p.hashes))
        for size, (begins, item) in p.windows.items():
            low, high = index.search(p.stream, begins, size)
            some = np.flatnonzero(high > low)
            # Equal windows have one range, which is located once.
            low, at, window = np.unique(low[some], return_index=True, return_inverse=True)
            many = high[some][at] - low
            pos = t + index.locate(np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum())))
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + size, -1)
            of = np.unique(np.column_stack([np.repeat(np.arange(len(low)), many), doc[back[pos]]]), axis=0)
            items = np.unique(np.column_stack([window, item[some]]), axis=0)
            n = np.bincount(items[:, 0], minlength=len(low))
            each, start = n[of[:, 0]], (np.cumsum(n) - n)[of[:, 0]]
            row = np.repeat(start - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            pairs.append(np.column_stack([np.repeat(of[:, 1], each), items[row, 1]]))
    hit[back[np.flatnonzero(np.cumsum(cover)[:-1] > 0)]] = True
    return hit, np.unique(np.concatenate(pairs), axis=0)


def spelled(texts: pa.Array, doc: np.ndarray, where: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, str]]:
    """Each of ``at``, which are places in (text, word index), with its word in lower case."""
    for i in np.split(at, np.flatnonzero(np.diff(doc[at])) + 1) if len(at) else []:
        words, n = WORD.finditer(texts[int(doc[i[0]])].as_py()), -1
        for k, at_word in zip(i.tolist(), where[i].tolist(), strict=True):
            while n < at_word:
                word, n = next(words), n + 1
            yield k, word[0].translate(LOWER)


def find(p: Phrases, texts: pa.Array, doc: np.ndarray, where: np.ndarray, number: np.ndarray, shard: int = SHARD_WORDS) -> tuple[np.ndarray, list, list]:
    """For each of ``texts``: words hit, merged spans of these (word indexes), items found.

    Benchmark words of one hash are told apart by their spelling before the search, and what is
    hit is compared as it is spelled afterwards: words that only share a hash are taken out.
    """
    if p.twins:
        twin, number = np.isin(number, list(p.twins.values())), number.copy()
        for k, word in spelled(texts, doc, where, np.flatnonzero(twin)):
            number[k] = p.twins.get(word, 0)
        doc, where, number = (x[number > 0] for x in (doc, where, number))
    while True:
        hit, pairs = occurrences(p, doc, where, number, shard)
        wrong = [k for k, word in spelled(texts, doc, where, np.flatnonzero(hit)) if word != p.names[number[k] - 1]]
        if not wrong:
            break
        doc, where, number = (np.delete(x, wrong) for x in (doc, where, number))
    n = len(texts)
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    doc, where = doc[hit], where[hit]
    if len(doc):
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 1) | (np.diff(doc) != 0))))
        for a, b in zip(begin, np.append(begin[1:], len(doc)), strict=True):
            spans[doc[a]].append({"start": int(where[a]), "end": int(where[b - 1]) + 1})
    for d, k in pairs:
        items[d].append(p.items[k])
    return np.bincount(doc, minlength=n), spans, items


SPANS = "array<struct<start:long,end:long>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, spans, items) for each row of ``docs`` (doc_id, text).

    Words are lower-cased runs as in ``words``. A window is ``window`` consecutive words of
    an item (item_id, text) of ``benchmark``, or all of a shorter item that has words. A word
    inside an occurrence of a window is hit; ``spans`` are the merged hit words (word
    indexes, end exclusive), ``items`` the ids found, as strings in order.

    A task's documents make up shards of ``shard_words`` words, each with an FM-index of its own:
    only runs of benchmark words can hold a window, so these are indexed, at their full number.
    Windows are found by the hashes of their words; the words of what is found are compared as
    they are, and words of the benchmark that share a hash have numbers of their own. A task holds
    about ``held_bytes`` of texts at a time. No shuffle, and nothing of the documents leaves its task. A benchmark of over
    BENCHMARK_BYTES is taken in blocks of items, each against all documents, one after another.

    Null and empty texts have no words. Items of the same id count as one; a null item_id
    is the empty string. Repeated rows stay repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // BENCHMARK_BYTES))
    base = long_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long, n_hit long, spans {SPANS}, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    passes = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        sent = spark.sparkContext.broadcast(phrases([tuple(r) for r in block.collect()], window))

        def run(batches, sent=sent):
            p, held, size = sent.value, [], 0

            def done():
                ids, hashes, texts = (pa.concat_arrays([b.column(c) for b, _ in held]) for c in ("doc_id", "text_hash", "text"))
                begins = np.cumsum([0] + [b.num_rows for b, _ in held])
                doc = np.concatenate([k[1] + i for (_, k), i in zip(held, begins, strict=False)])
                hits, spans, found = find(p, texts, doc, *(np.concatenate([k[c] for _, k in held]) for c in (2, 3)), shard_words)
                columns = [ids, hashes, pa.array(np.concatenate([k[0] for _, k in held])), pa.array(hits), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_words", "n_hit", "spans", "items"])

            for batch in batches:
                held.append((batch, known(p, batch.column("text"))))
                size += batch.nbytes + len(held[-1][1][1]) * (held_bytes // shard_words)
                if size >= held_bytes:
                    yield done()
                    held, size = [], 0
            if held:
                yield done()

        rows = base.mapInArrow(run, schema)
        if n_blocks > 1:  # each pass is run on its own, so that one block is out at a time
            rows = cut(rows)
            sent.destroy()
        passes.append(rows)
    if n_blocks == 1:
        return passes[0]
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.union(more)
    # Rows of a document and text are alike, so one of each pass and their number say all.
    once = rows.groupBy("doc_id", "text_hash", "n_words", "n_hit", "spans", "items").agg(F.count("*").alias("n"))
    met = once.groupBy("doc_id", "text_hash", "n_words").agg(F.max("n").alias("n"), F.sum("n").alias("all"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    met = met.withColumn("spans", F.aggregate("s", F.array().cast(SPANS), join))
    met = met.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    return met.select("doc_id", "text_hash", "n_words", "n_hit", "spans", "items", F.explode(F.sequence(F.lit(1), (F.col("all") / n_blocks).cast("int"))).alias("copy")).drop("copy")


def contaminated():
    """The rule: at least a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
