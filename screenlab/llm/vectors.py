"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, cut, join_frequent

#: Rows of a label or cell compared at a time; a fuller one is taken in pairs of such chunks.
CHUNK = 8192
#: Rows of a large label by which its selectivity is measured, and coordinates of a block that cells may use.
SAMPLE, MOST_COORDINATES = 384, 3
#: What it costs to send a row to a task, in differences of coordinates.
ROW_COST = 20_000
#: Budgets are wider than the share by this much, which covers the rounding of rotated single-precision values.
SLACK, SLACK_ADDED = 1 + 1e-5, 1e-9


@cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, which spreads the vectors' energy over all dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; first scaled so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def subspaces(dim: int, width: int, threshold: float) -> tuple[list[slice], np.ndarray]:
    """Blocks of about ``width`` dimensions, and the squared distance that each may use up."""
    n = max(1, dim // width)
    sizes = [dim // n + (k < dim % n) for k in range(n)]
    ends = np.cumsum(sizes)
    budgets = np.array([(2 - 2 * threshold) * s / dim for s in sizes]) * SLACK + SLACK_ADDED
    return [slice(e - s, e) for s, e in zip(sizes, ends, strict=True)], budgets


def gaps(x: np.ndarray, p: np.ndarray, q: np.ndarray, block: slice) -> np.ndarray:
    """Squared distances within a block: the one test of whether two rows meet in it."""
    d = x[p, block] - x[q, block]
    return (d * d).sum(1)


def meet(x: np.ndarray, home: np.ndarray, other: np.ndarray | None, block: slice, budget: float, met=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers) of ``home`` and ``other``, or within ``home``, that are within the budget in a block.

    Both sides are ordered by the block's first coordinate, so a slab of one is compared with
    the band of the other that it can reach. Each pair comes once; those that ``met`` (a
    function of two lists of rows) knows are left out.
    """
    home = home[np.argsort(x[home, block.start])]
    other, alone = (home, True) if other is None else (other[np.argsort(x[other, block.start])], False)
    first, reach = x[other, block.start], np.sqrt(budget)
    for s in range(0, len(home), 128):
        i = home[s : s + 128]
        low = s if alone else np.searchsorted(first, x[i[0], block.start] - reach)
        j = other[low : np.searchsorted(first, x[i[-1], block.start] + reach, "right")]
        a, b = x[i, block], x[j, block]
        # The expanded square picks, with room for its rounding; the difference decides.
        near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T) <= budget + 1e-9
        p, q = np.nonzero(near & ~met(i, j) if met else near)
        if alone:
            p, q = p[p < q], q[p < q]
        p, q = i[p], j[q]
        near = gaps(x, p, q, block) <= budget
        yield p[near], q[near]


def verified(unit: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose cosine reaches the threshold, in double precision."""
    keep = [np.zeros(0, bool)] + [np.einsum("ij,ij->i", unit[p[s : s + 32_768]], unit[q[s : s + 32_768]]) >= threshold for s in range(0, len(p), 32_768)]
    keep = np.concatenate(keep)
    return p[keep], q[keep]


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the smallest that the links (a, b) join it to."""
    up = np.arange(n)
    while True:  # each row hangs on the smallest it is linked to, then paths are shortened
        low = up.copy()
        np.minimum.at(low, up[a], up[b])
        np.minimum.at(low, up[b], up[a])
        while (low != low[low]).any():
            low = low[low]
        if (low[up] == up).all():
            return up
        up = low[up]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that join the same of ``n`` rows as the links (a, b) do."""
    up = joined(a, b, n)
    return [(int(i), int(up[i])) for i in np.flatnonzero(up != np.arange(n))]


class Links:
    """What a task keeps of its links: how many each row has, weighted by copies, and which rows they join."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.count, self.up = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        for i, j in ((p, q), (q, p)):
            self.count += np.bincount(i, self.copies[j], len(self.ids)).astype(np.int64)
        a, b = self.up[p], self.up[q]
        if (apart := a != b).any():
            self.up = joined(a[apart], b[apart], len(self.up))[self.up]

    def table(self) -> pd.DataFrame:
        """(a, b, links): a row with itself and its links, and edges of a spanning forest."""
        some, tree = np.flatnonzero(self.count), np.flatnonzero(self.up != np.arange(len(self.up)))
        links = np.concatenate([self.count[some], np.zeros(len(tree), np.int64)])
        return pd.DataFrame({"a": self.ids[np.concatenate([some, tree])], "b": self.ids[np.concatenate([some, self.up[tree]])], "links": links})


def cells_of(x: np.ndarray, block: slice, budget: float, coordinates: int) -> np.ndarray:
    """Cells with sides of the budget's radius on the first coordinates of a block."""
    return np.floor(x[:, block.start : min(block.stop, block.start + coordinates)] / np.sqrt(budget)).astype(np.int64)


def steps(coordinates: int) -> list[tuple[int, ...]]:
    """Home, and the half of the neighbouring cells that a row visits: each two neighbours meet once."""
    return [o for o in itertools.product((-1, 0, 1), repeat=coordinates) if o >= (0,) * coordinates]


def cheapest(x: np.ndarray, n: int, width: int, threshold: float, chunk: int = CHUNK, row_cost: float = ROW_COST) -> int:
    """On how many coordinates of each block a label of ``n`` rows, of which ``x`` is a sample, is best dealt to cells; 0: on none.

    Dealt whole, every pair of rows meets once and a row is sent to as many tasks as there are
    chunks. In cells, only rows of neighbouring cells are compared, block by block.
    """
    blocks, budgets = subspaces(x.shape[1], width, threshold)
    p, q = np.triu_indices(len(x), 1)
    cost = []
    for m in range(MOST_COORDINATES + 1):
        work, copies = 0.0, 0 if m else -(-n // chunk)
        for b, budget in zip(blocks, budgets, strict=True):
            near = np.abs(x[p, b.start] - x[q, b.start]) <= np.sqrt(budget)  # the band, in cells or not
            if m:
                c = cells_of(x, b, budget, m)
                near &= (np.abs(c[p] - c[q]) <= 1).all(1)
                copies += len(steps(c.shape[1]))
            work += (near.mean() if len(p) else 1.0) * (b.stop - b.start)
        cost.append(n * n / 2 * work + n * copies * row_cost)
    return int(np.argmin(cost))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, width: int = 8, chunk: int = CHUNK, row_cost: float = ROW_COST) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors of the same label are linked when their cosine is at least ``threshold``.
    Unit vectors that near are within a squared distance of 2 - 2 * threshold; rotated and
    split into blocks of about ``width`` dimensions, they keep within the proportional share
    of it in some block. So each block is range-joined under its budget, and the union of
    the pairs is verified in double precision.

    Labels of up to ``chunk`` different vectors are joined in one task, block after block, each as
    a band join on the block's first coordinate. Of a larger label a sample tells what cells
    on one to three coordinates of each block would spare: where that outweighs the copies (at ``row_cost`` each),
    a vector is at home in its cell of each block and visits half of the neighbours, and a pair
    is verified in the first block that it meets in; else the label is dealt as pairs of
    chunks, in which each pair of vectors meets once. Cells of over ``chunk`` vectors are dealt as
    chunks too. Each task returns counts and a spanning forest, so neither pairs nor a label's
    or cell's rows meet in one place.

    Equal vectors of a label are joined as one, with their number. Null, zero and non-finite
    vectors, and those of a null label, have no links and are components of their own. Rows
    that repeat a vec_id are linked as copies. Ids and labels have any types that can be
    ordered; further columns are ignored. An empty table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype("float32" if single else "float64")  # as exact as they came
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))

    def pack(batches):
        for batch in batches:
            column = batch.column("embedding")
            at = column.offsets.to_numpy()
            x = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # one zero only
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            some = np.concatenate(([0], np.cumsum(x != 0)))
            ok = (np.diff(bad[at]) == 0) & (np.diff(some[at]) > 0) & column.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            v = [x[a:b].tobytes() if o else None for a, b, o in zip(at[:-1], at[1:], ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    packed = rows.mapInArrow(pack, f"vec_id {id_type}, label {label_type}, v binary")
    # One row for each different vector of a label: copies are counted, the smallest id stands for them.
    classes = cut(packed.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", (F.octet_length("v") / kind.itemsize).cast("int")))
    found = cut(_met(classes, kind, threshold, width, chunk, row_cost, id_type, label_type))
    top = components(found.where("a <> b").select("a", "b"))
    links = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    got = classes.join(links, "id", "left").join(top, "id", "left")
    got = cut(got.select("label", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    count = got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = join_frequent(packed.where("v is not null"), got, ["label", "v"], "n", count).select("vec_id", "n_links", "component_id")
    return linked.union(packed.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))


def _vectors(pdf: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    return units(np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), -1))


def layout(classes: DataFrame, kind: np.dtype, threshold: float, width: int, chunk: int, row_cost: float) -> DataFrame:
    """(label, dim, rows, coordinates) of labels of several vectors: on how many coordinates of its blocks each is dealt to cells, 0 for whole."""
    key, label_type = ["label", "dim"], classes.schema["label"].dataType.simpleString()
    groups = bounded(classes.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1"))
    large = groups.where(F.col("rows") > chunk)
    if large.isEmpty():
        return groups.withColumn("coordinates", F.lit(0))

    # Larger labels: their selectivity is measured on about SAMPLE rows of the least hashes.
    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _vectors(pdf, kind)
        m = cheapest(unit @ rotation(unit.shape[1]), int(pdf["rows"].iloc[0]), width, threshold, chunk, row_cost)
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "coordinates": [m]})

    some = classes.join(large, key).where((F.xxhash64("v").cast("double") / F.lit(2.0**64) + 0.5) * F.col("rows") < SAMPLE)
    chosen = some.groupBy(*key).applyInPandas(measure, f"label {label_type}, dim int, coordinates int")
    return bounded(groups.join(chosen, key, "left").select(*key, "rows", F.coalesce("coordinates", F.lit(0)).alias("coordinates")))


def _met(classes: DataFrame, kind: np.dtype, threshold: float, width: int, chunk_rows: int, row_cost: float, id_type: str, label_type: str) -> DataFrame:
    """(a, b, links) of all tasks: a = b with the links that a task found, and edges of spanning forests."""
    schema, key = f"a {id_type}, b {id_type}, links long", ["label", "dim"]
    dealt = layout(classes, kind, threshold, width, chunk_rows, row_cost)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _vectors(pdf, kind)
        x, chunk = unit @ rotation(unit.shape[1]), pdf["chunk"].to_numpy()
        one, two = np.flatnonzero(chunk == pdf["one"].iloc[0]), np.flatnonzero(chunk == pdf["two"].iloc[0])
        same, place = pdf["one"].iloc[0] == pdf["two"].iloc[0], np.empty(len(pdf), np.int64)
        place[one] = np.arange(len(one))
        place[two] = np.arange(len(two))
        met = np.zeros((len(one), len(two)), bool)  # the union over the blocks
        for b, budget in zip(*subspaces(x.shape[1], width, threshold), strict=True):
            for p, q in meet(x, one, None if same else two, b, budget, lambda i, j: met[np.ix_(place[i], place[j])]):
                met[place[p], place[q]] = True
                if same:
                    met[place[q], place[p]] = True
        found = Links(pdf["id"].to_numpy(), pdf["n"].to_numpy())
        for s in range(0, len(one), 64):
            part = met[s : s + 64]
            if part.mean() < 0.05:
                p, q = np.nonzero(part)
                p, q = verified(unit, one[s + p], two[q], threshold)
            else:  # most of them meet: the cosines of all at once, but for those too near the threshold
                product = unit[one[s : s + 64]] @ unit[two].T
                p, q = np.nonzero(part & (product >= threshold + 1e-9))
                i, j = np.nonzero(part & (np.abs(product - threshold) < 1e-9))
                i, j = verified(unit, one[s + i], two[j], threshold)
                p, q = np.concatenate((one[s + p], i)), np.concatenate((two[q], j))
            found.add(p[p < q] if same else p, q[p < q] if same else q)
        return found.table()

    done = _in_pairs(classes.join(dealt.where("coordinates = 0"), key), key, chunk_rows).groupBy("label", "dim", "one", "two").applyInPandas(whole, schema)
    if dealt.where("coordinates > 0").isEmpty():
        return done

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, m), part in pdf.groupby(["dim", "coordinates"]):
                x = (_vectors(part, kind) @ rotation(dim)).astype(np.float32)
                sent = part[["label", "dim", "id", "n", "v"]].assign(x=[r.tobytes() for r in x])
                for k, (b, budget) in enumerate(zip(*subspaces(dim, width, threshold), strict=True)):
                    cell = cells_of(x.astype(np.float64), b, budget, m)
                    for step in steps(cell.shape[1]):
                        yield sent.assign(block=k, cell=list(cell + np.array(step)), visit=int(any(step)))

    cells = classes.join(dealt.where("coordinates > 0"), key).select(*key, "id", "n", "v", "coordinates")
    cells = cells.mapInPandas(place, f"label {label_type}, dim int, id {id_type}, n long, v binary, x binary, block int, cell array<long>, visit int")
    by = ["label", "dim", "block", "cell"]
    full = cells.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(1 - F.col("visit")).alias("homes")).where("homes > 0 and rows > 1").drop("homes")

    def in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, k, found = _vectors(pdf, kind), int(pdf["block"].iloc[0]), Links(pdf["id"].to_numpy(), pdf["n"].to_numpy())
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
        blocks, budgets = subspaces(x.shape[1], width, threshold)
        chunk, visit, one, two = pdf["chunk"].to_numpy(), pdf["visit"].to_numpy(), pdf["one"].iloc[0], pdf["two"].iloc[0]
        at = lambda c, v: np.flatnonzero((chunk == c) & (visit == v))
        jobs = [(at(one, 0), None), (at(one, 0), at(one, 1))] if one == two else [(at(one, 0), at(two, 0)), (at(one, 0), at(two, 1)), (at(two, 0), at(one, 1))]
        for i, j in jobs:
            for p, q in meet(x, i, j, blocks[k], budgets[k]):
                for e in range(k):  # a pair that meets in an earlier block belongs to it
                    later = gaps(x, p, q, blocks[e]) > budgets[e]
                    p, q = p[later], q[later]
                found.add(*verified(unit, p, q, threshold))
        return found.table()

    return done.union(_in_pairs(cells.join(full, by), by, chunk_rows).groupBy(*by, "one", "two").applyInPandas(in_cell, schema))


def _in_pairs(rows: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """Rows of groups of ``rows`` rows dealt to chunks, each as often as there are pairs of chunks with its own: (one, two)."""
    chunks = F.ceil(F.col("rows") / chunk).cast("int")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("v"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other")).drop("rows", "other")
