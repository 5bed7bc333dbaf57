"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, cut, join_frequent, long_rows
from .vectors import forest
from .words import blocks, hash_words, mix, shingles, text_buffer

#: MinHash values, in bands of ROWS; a pair at 0.8 shares no band with a chance of 5e-8.
HASHES, ROWS = 128, 4
#: Values compared at a time, and the posterior chance below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members and bytes of shingles of a bucket compared at a time; a larger one is taken in pairs of such chunks.
CHUNK, CHUNK_BYTES = 512, 32_000_000


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def minhash(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each text that has shingles (a row of the largest value for others)."""
    n = len(begins) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begins))
    v = (values >> np.uint64(32)).astype(np.uint32)
    a, b = _multipliers()
    i = 0
    while i < len(some):  # as much as stays in the processor's cache
        j = max(i + 1, int(np.searchsorted(begins[some], begins[some[i]] + (1 << 17))))
        part = some[i:j]
        low = begins[part[0]]
        x, at = v[low : begins[part[-1] + 1]], begins[part] - low
        for k in range(HASHES):
            out[part, k] = np.minimum.reduceat(x * a[k] + b[k], at)
        i = j
    return out


def compared(m: np.ndarray) -> np.ndarray:
    """A byte of each minimum: minima are small numbers, so they are spread first; different ones agree by 1 in 256."""
    return (m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values in order; ``values`` is sorted in place."""
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles of each text in order, where each text's begin) for blocks of rows."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets):
        s, begins = shingles(*hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
        parts = [distinct(s[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
        sizes = np.array([len(p) for p in parts])
        yield i, parts[0] if len(parts) == 1 else np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


def set_ids(s: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64)).astype(np.int64)


@cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values: the fewest equal ones that leave hope.

    With a uniform prior, the posterior of the similarity J after m of n equal bytes is in
    proportion to p**m * (1-p)**(n-m), p = J + (1-J)/256. A pair goes when its chance of
    J >= threshold falls below the tolerance.
    """
    j = (np.arange(20_000) + 0.5) / 20_000
    p = j + (1 - j) / 256
    out = []
    for n in range(HASHES + 1):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[j >= threshold].sum() >= tolerance * w.sum():
                break
        out.append(m)
    return out


def pruned(m: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay when their values are compared step by step."""
    least, same = least_matches(threshold), np.zeros(len(p), np.int64)
    for k in range(0, HASHES, STEP):
        same = same + (m[p, k : k + STEP] == m[q, k : k + STEP]).sum(1)
        keep = same >= least[k + STEP]
        p, q, same = p[keep], q[keep], same[keep]
        if not len(p):
            break
    return p, q


def met_before(kept: list[np.ndarray], key: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket of a smaller key."""
    small = [k[k < key] for k in kept]
    if len(kept) <= 16:
        own = [set(k.tolist()) for k in small]
        return np.array([not own[a].isdisjoint(own[b]) for a, b in zip(p, q, strict=True)], bool)
    names, at = np.unique(np.concatenate(small), return_inverse=True)
    row = np.repeat(np.arange(len(kept)), [len(k) for k in small])
    shared = np.zeros((len(kept), len(kept)), np.float32)
    for s in range(0, len(names), 4096):
        part = (at >= s) & (at < s + 4096)
        a = np.zeros((len(kept), min(4096, len(names) - s)), np.float32)
        a[row[part], at[part] - s] = 1
        shared += a @ a.T
    return shared[p, q] > 0


def similar(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, counted on the whole sets."""
    size = np.array([len(s) for s in sets])
    if len(p) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p, q, strict=True)])
    else:  # counts of all pairs of the chunk from its incidence matrix, in slabs of shingles
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        total = np.zeros((len(sets), len(sets)))
        for s in range(0, len(names), 4096):
            i, j = np.searchsorted(at, (s, s + 4096))
            a = np.zeros((len(sets), min(4096, len(names) - s)), np.float32)
            a[row[i:j], at[i:j] - s] = 1
            total += a @ a.T
        both = total[p, q].astype(np.int64)
    return both >= threshold * (size[p] + size[q] - both) - 1e-9


def linked(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float, all_links: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that reach the threshold; if not ``all_links``, as many of them as join all that they join."""
    if all_links:
        ok = similar(sets, p, q, threshold)
        return p[ok], q[ok]
    n, found = len(sets), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for turn in range(5):  # a pair for each row that is not joined to its partner yet; at last all such pairs
        up = np.arange(n)
        for i, j in forest(*(np.concatenate(x) for x in zip(*found, strict=True)), n):
            up[i] = j
        apart = up[p] != up[q]
        p, q = p[apart], q[apart]
        if not len(p):
            break
        some = np.unique(q, return_index=True)[1] if turn < 4 else np.arange(len(p))
        ok = similar(sets, p[some], q[some], threshold)
        found.append((p[some][ok], q[some][ok]))
        p, q = np.delete(p, some), np.delete(q, some)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hopeful(key: int, rows: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of one pair of chunks of a bucket that are neither pruned nor met in an earlier bucket."""
    one, two = rows[0]["one"], rows[0]["two"]
    chunk = np.array([r["chunk"] for r in rows])
    if one == two:
        p, q = np.triu_indices(len(rows), 1)
    else:
        p, q = (x.ravel() for x in np.meshgrid(np.flatnonzero(chunk == one), np.flatnonzero(chunk == two), indexing="ij"))
    p, q = pruned(np.frombuffer(b"".join(r["mh"] for r in rows), np.uint8).reshape(len(rows), HASHES), p, q, threshold)
    if len(p):
        new = ~met_before([np.asarray(r["kept"]) for r in rows], key, p, q)
        p, q = p[new], q[new]
    return p, q


def screened(rows: list[dict], threshold: float) -> list[tuple]:
    """(key, one, two, chunk, c) of the rows of a pair of chunks that are in a hopeful pair."""
    key, one, two = (rows[0][x] for x in ("key", "one", "two"))
    some = np.unique(np.concatenate(hopeful(key, rows, threshold)))
    return [(key, one, two, rows[i]["chunk"], rows[i]["c"]) for i in some]


def verified(rows: list[dict], threshold: float, all_links: bool) -> list[tuple]:
    """(a, b, links) of one pair of chunks of a bucket: counts of links, and edges that join the linked."""
    p, q = hopeful(rows[0]["key"], rows, threshold)
    p, q = linked([np.frombuffer(r["set"], np.uint64) for r in rows], p, q, threshold, all_links)
    copies, ids = np.array([r["copies"] for r in rows]), [r["c"] for r in rows]
    links = np.bincount(p, copies[q], len(rows)) + np.bincount(q, copies[p], len(rows))
    return [(ids[i], ids[i], int(links[i])) for i in np.flatnonzero(links)] + [(ids[i], ids[j], 0) for i, j in forest(p, q, len(rows))]


def by_bucket(f, schema: pa.Schema):
    """A function for mapInArrow over rows sorted by (key, one, two): ``f`` of the rows of each, as tuples."""

    def run(batches):
        held: list[dict] = []

        def groups(last: bool):
            """Whole groups of the rows held; the last one may go on in the next batch."""
            nonlocal held
            i = 0
            for j in range(1, len(held) + 1):
                if j == len(held) or any(held[j][x] != held[i][x] for x in ("key", "one", "two")):
                    if j == len(held) and not last:
                        break
                    yield held[i:j]
                    i = j
            held = held[i:]

        def done(last: bool):
            out = [row for rows in groups(last) for row in f(rows)]
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                held += batch.slice(start, 512).to_pylist()
                yield done(False)
        yield done(True)

    return run


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, parts_of: bool = False, all_links: bool = True) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of ``n``-word
    shingles is at least ``threshold`` (0.8 here: the bands are set for that or more). A text
    of fewer words, but not none, has one shingle. n_links counts the documents linked,
    copies included; class_id is the smallest doc_id reachable over links.

    Documents of the same set are one class with a count. Classes meet in the buckets of
    MinHash bands; buckets of the same members are kept once. Within a bucket, values are
    compared step by step, hopeless pairs dropped by their posterior, and pairs that meet in an
    earlier bucket left to it. Only the classes that are in a pair left, mostly in one bucket
    each, get their whole sets, on which these pairs are verified. A bucket over CHUNK is
    dealt out as pairs of chunks. Tasks return counts and spanning edges, never pairs.

    Without ``all_links`` a pair is not verified once its two are joined by others, and the chunks
    of a bucket meet the first and then only those that have something left to join: class_id is
    the same, n_links only tells whether there are any, and a bucket of near copies of one
    text is work in proportion to it, not to its square.

    Null and empty texts, and texts without words, link with nothing, and so do rows of a
    null doc_id (class_id null). Other columns are ignored; repeated rows are copies. An empty
    table gives an empty result.

    With ``parts_of`` come text_hash and ``part``, a number for what is linked: classes of
    different texts can have one class_id where a doc_id has several texts. It is null for
    rows that link with nothing by nature.
    """
    found = _joined(docs, threshold, n, all_links)
    return found if parts_of else found.select("doc_id", "class_id", "n_links")


def _joined(docs: DataFrame, threshold: float, n: int, all_links: bool) -> DataFrame:
    """All columns of join()."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            c, size, keys, mh = [], [], [], []
            for _, s, begins in sets_of(batch.column("text"), n):
                m = minhash(s, begins)
                c.append(set_ids(s, begins))
                size.append(np.diff(begins))
                bands = m.reshape(len(m), -1, ROWS).astype(np.uint64)
                k = np.zeros(bands.shape[:2], np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
                for r in range(ROWS):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
                keys.append(k.astype(np.int64).ravel())
                mh += [x.tobytes() for x in compared(m)]
            rows = len(mh)
            if rows:
                flat = pa.array(np.concatenate(keys))
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * (HASHES // ROWS))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate(c)), pa.array(np.concatenate(size).astype(np.int32)), pa.ListArray.from_arrays(offsets, flat), pa.array(mh, pa.binary())], names=["doc_id", "text_hash", "c", "size", "keys", "mh"])

    base = long_rows(docs).select("doc_id", "text")
    signed = cut(base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, f"doc_id {id_type}, text_hash long, c long, size int, keys array<long>, mh binary"))
    usable = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    classes = cut(signed.where(usable).groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("mh").alias("mh")))
    banded = classes.select("c", "size", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(F.xxhash64("c")).alias("x"), F.sum("size").alias("shingles")).where("n > 1")
    once = buckets.groupBy("n", "low", "high", "x", "shingles").agg(F.min("key").alias("key"), F.first("n").alias("many"))
    once = cut(once.select("key", "many", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("shingles") * 8 / CHUNK_BYTES)).cast("int").alias("chunks")))
    members = cut(join_frequent(banded.select("key", "c"), once, ["key"], "many", once.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]).select("key", "c", "chunks"))
    kept = members.groupBy("c").agg(F.sort_array(F.collect_list("key")).alias("kept"))  # at most one for each band
    needed = cut(classes.select("c", "rep", "copies", "mh").join(kept, "c"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["key", "one", "two"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *by).sortWithinPartitions(*by)

    members = members.withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("chunks") - 1)
    places = pa.schema([("key", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("chunk", pa.int32()), ("c", pa.int64())])
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def whole(batches):
        for batch in batches:
            c, sets = [], []
            for _, s, begins in sets_of(batch.column("text"), n):
                c.append(set_ids(s, begins))
                sets += [s[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)), pa.array(sets, pa.binary())], names=["c", "set"])

    def compared_in(chunk_pairs: DataFrame) -> DataFrame:
        """(a, b, links) of pairs of chunks: screened by MinHash, then verified on the sets."""
        hope = dealt(chunk_pairs.join(needed.select("c", "mh", "kept"), "c")).mapInArrow(by_bucket(lambda rows: screened(rows, threshold), places), "key long, one int, two int, chunk int, c long")
        hope = cut(hope)
        wanted = needed.join(hope.select("c").distinct(), "c", "left_semi")
        reps = bounded(wanted.select(F.col("rep").alias("doc_id")).distinct())
        sets = base.join(reps, "doc_id", "left_semi").select("text").mapInArrow(whole, "c long, set binary")
        sets = wanted.join(sets.groupBy("c").agg(F.first("set").alias("set")), "c").drop("rep")
        return cut(dealt(hope.join(sets, "c")).mapInArrow(by_bucket(lambda rows: verified(rows, threshold, all_links), edges), "a long, b long, links long"))

    if all_links or once.where("chunks > 2").isEmpty():
        found = compared_in(_in_pairs(members, each))
    else:
        # Each chunk with itself and with the first; of the other pairs of chunks those that may join something yet.
        found = compared_in(_in_pairs(members, F.when(F.col("chunk") == 0, each).otherwise(F.array(F.lit(0), "chunk"))))
        found = found.union(compared_in(_unsettled(members, found)))
    top = components(found.where("a <> b").select("a", "b"))
    named = cut(top.join(classes.select(F.col("c").alias("id"), "rep"), "id"))
    groups = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("many"))
    named = join_frequent(named.select("id", "component"), groups, ["component"], "many", named.count()).select(F.col("id").alias("c"), "class_id", "component")
    links = found.where("links > 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    by_class = classes.select("c", "rep", "copies").join(links, "c", "left").join(named, "c", "left")
    by_class = cut(by_class.select("c", "copies", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("component", "c").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = signed.where(usable).select("doc_id", "text_hash", "c")
    done = join_frequent(rows, by_class, ["c"], "copies", by_class.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]).select("doc_id", "class_id", "n_links", "text_hash", "part")
    return done.union(signed.where(~usable).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(None).cast("long").alias("part")))


def _in_pairs(members: DataFrame, others: Column) -> DataFrame:
    """Members of buckets once for each of the chunks in ``others``: rows of the pairs of chunks (one, two)."""
    rows = members.withColumn("other", F.explode(others))
    return rows.select("key", "c", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the pairs of chunks, the first aside, that do not lie wholly in the largest component of their bucket.

    So a bucket of near copies of one text, whose chunks the first has joined, asks for no more
    work: it grows with the bucket instead of its square.
    """
    members = members.where("chunks > 2")
    top = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "c")
    rows = members.join(top, "c", "left").withColumn("component", F.coalesce("component", "c"))
    # A row for each bucket of over two chunks: few beside the members.
    most = bounded(rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("largest")))
    mixed = rows.join(most, "key").where(F.col("component") != F.col("largest")).groupBy("key").agg(F.collect_set("chunk").alias("mixed"))
    later = members.where("chunk > 0").join(bounded(mixed), "key")
    others = F.when(F.array_contains("mixed", F.col("chunk")), F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.filter("mixed", lambda o: o > 0))
    return _in_pairs(later, F.filter(others, lambda o: o != F.col("chunk")))
