"""Passages that repeat across documents, found by suffix orders and removed byte by byte.

A string of WIDTH bytes goes to the group of its least gram, so equal strings of different
documents meet wherever they stand. Only stretches whose gram occurs in two documents are
looked at further; equal stretches are one with their smallest doc_id. The stretches of a
group stand in lanes of bounded length, whose suffixes are sorted by linear grouping
(``suffixes``); neighbours that agree in WIDTH bytes are equal strings. A group of very many
stretches is cut by longer grams, and by whole strings in the end, and aggregated before it
is shuffled, so no task holds all rows of a frequent passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, join_frequent, long_rows, saved
from .suffixes import _ranges, suffix_orders
from .words import BLOCK, _powers, mix, text_buffer

#: Bytes of a string that counts as repeated.
WIDTH = 50
#: Lengths of the grams by which strings are grouped, one after the other for groups that stay too large.
GRAMS = (24, 38)
#: Documents of a gram beyond which its stretches are cut into strings at once, and different stretches of a gram beyond which they are cut by the next gram.
GROUP_ROWS, GROUP_PARTS = 5000, 31
#: Strings of a stretch (a mask of them is a long), symbols of a lane that is full, and bytes of stretches that a task sorts at a time; each takes some 70 bytes of memory.
RUN, LANE, LANES = 32, 512, 1 << 20
#: Stretches whose bytes are cut out at a time, and rows of a batch that goes back to Spark.
PIECE = 1 << 15
#: Stands for two or more documents.
MANY = -(2**63)


def stretches(data: np.ndarray, offsets: np.ndarray, gram: int, width: int, single: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, strings, gram hash, name) of runs of strings of ``width`` bytes that have one least gram, piece by piece.

    A run has at most RUN strings, with ``single`` one. Starts are bytes of ``data``; a name is
    another hash, of the whole run: with the gram's, equal runs share 128 bits.
    """
    span = width - gram + 1
    for s in range(0, max(len(data) - width + 1, 0), BLOCK - width + 1):
        part = data[s : s + BLOCK]
        power, inverse = _powers(BLOCK + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        low, size = h, 1
        while 2 * size <= span:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        low = np.minimum(low[: len(h) - span + 1], low[span - size :])
        edge = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=edge[1:])
        i, j = np.searchsorted(offsets, (s, s + len(low) + width))
        for at in (offsets[i:j] - s, offsets[i:j] - s - width + 1):  # where a text's strings begin and end
            edge[at[(at >= 0) & (at < len(low))]] = True
        starts = np.flatnonzero(edge)
        many = np.diff(np.append(starts, len(low)))
        pieces = -(-many // RUN)
        if len(pieces) and pieces.max() > 1:
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, many = np.repeat(starts, pieces) + RUN * k, np.minimum(np.repeat(many, pieces) - RUN * k, RUN)
        text = np.searchsorted(offsets, starts + s, "right") - 1
        keep = offsets[text + 1] - s - starts >= width
        text, starts, many = text[keep], starts[keep], many[keep]
        if single:
            starts, text = _ranges(starts, many), np.repeat(text, many)
            many = np.ones(len(starts), np.int64)
        name = mix((sums[starts + many + width - 1] - sums[starts]) * inverse[starts] * np.uint64(0xD6E8FEB86659FD93) + many.astype(np.uint64))
        yield text, starts + s, many, low[starts].view(np.int64), name.view(np.int64)


def contents(data: np.ndarray, starts: np.ndarray, many: np.ndarray, width: int) -> pa.Array:
    """The bytes of runs of ``many`` strings."""
    size = many + width - 1
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    whole = data[_ranges(starts, size)] if len(size) else data[:0]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(whole))]).cast(pa.binary())


def _docs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return ids, *text_buffer(batch.column("text"))


def grams_shared(docs: DataFrame, groups: int, gram: int, width: int) -> DataFrame:
    """(doc_id, gram): the least grams of each document that another has too. ``docs`` have ids.

    A batch names each gram once, with its document or as one of many; the documents of grams
    that a batch itself has twice need no answer, and go along as they are.
    """

    def batch_grams(batches):
        for batch in batches:
            ids, data, offsets = _docs(batch)
            found = [(t, g) for t, _, _, g, _ in stretches(data, offsets, gram, width)]
            if not found:
                continue
            doc, h = ids[np.concatenate([t for t, _ in found])], np.concatenate([g for _, g in found])
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
            doc, h = doc[once], h[once]
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
            many = np.diff(np.append(begin, len(h)))
            twice = np.repeat(many > 1, many)
            one = np.where(many > 1, MANY, doc[begin]), h[begin]
            for sure, (d, g) in ((False, one), (True, (doc[twice], h[twice]))):
                to = (d if sure else g).view(np.uint64) % np.uint64(groups)  # answers that are known meet no other row
                order = np.argsort(to, kind="stable")
                d, g, to = d[order], g[order], to[order]
                at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))[: len(to)])
                cuts = np.append(at, len(to)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (d, g)]
                yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int64)), pa.array(np.full(len(at), sure)), *lists], ["part", "sure", "docs", "grams"])

    def shared(table: pa.Table) -> pa.Table:
        sure = np.repeat(table.column("sure").to_numpy(), table.column("docs").combine_chunks().value_lengths().to_numpy())
        doc, h = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "grams"))
        own = h[~sure], doc[~sure]
        order = np.lexsort(own[::-1])
        g, d = own[0][order], own[1][order]
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))[: len(g)])
        end = np.append(begin[1:], len(g)) - 1
        both = np.repeat((d[begin] != d[end]) | (d[begin] == MANY), end - begin + 1) & (d != MANY) if len(g) else np.zeros(0, bool)
        found = pa.table({"doc_id": np.concatenate((doc[sure], d[both])), "gram": np.concatenate((h[sure], g[both]))})
        return pa.Table.from_batches(found.to_batches(PIECE), found.schema)

    dealt = docs.mapInArrow(batch_grams, "part long, sure boolean, docs array<long>, grams array<long>")
    return dealt.groupBy("part").applyInArrow(shared, "doc_id long, gram long")


#: Of a stretch: its group, its content by name and as bytes, the document, and to which bits of which stretch of the document its strings belong.
#: A mask instead tells which strings of the document's stretch ``root`` occur in a smaller doc_id.
ROWS = "gram long, name long, content binary, doc_id long, root long, shift int, mask long"


def _bits(many: np.ndarray) -> np.ndarray:
    return (np.int64(1) << many.astype(np.int64)) - 1


def _order(gram: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, over): an order in which equal stretches follow each other by doc_id, and whether there is one of a smaller doc_id."""
    order = np.lexsort((doc, name, gram))
    gram, name, doc = gram[order], name[order], doc[order]
    begin = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])))[: len(doc)])
    return order, doc > np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))


def _replies(doc: np.ndarray, root: np.ndarray, shift: np.ndarray, many: np.ndarray) -> pa.Table:
    """Replies that all ``many`` strings of stretches occur in a smaller doc_id."""
    return pa.table({"doc_id": doc, "root": root, "mask": _bits(many) << shift.astype(np.int64)})


def _settled(rows: pa.Table, width: int) -> tuple[pa.Table, pa.Table]:
    """(replies, rest) of rows: of equal stretches only the rows of the smallest doc_id are left to look at, one for each root."""
    gram, name, doc, root, shift = (rows.column(c).to_numpy() for c in ("gram", "name", "doc_id", "root", "shift"))
    order, over = _order(gram, name, doc)
    gone = order[over]
    many = pa.compute.binary_length(rows.column("content")).to_numpy()[gone] - width + 1
    return _replies(doc[gone], root[gone], shift[gone], many), rows.take(order[~over])


def _equal_strings(contents: list[bytes], docs: np.ndarray, lanes: np.ndarray, width: int) -> np.ndarray:
    """For each content a mask of its strings that a content of the same lane and a smaller doc_id holds too."""
    lens = np.fromiter(map(len, contents), np.int64, len(contents))
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    begins = np.cumsum(lens + 1) - lens - 1
    symbols = text.astype(np.int64) + 1
    symbols[begins + lens] = 0  # ends a stretch, below every byte
    lane_at = np.flatnonzero(np.concatenate(([True], lanes[1:] != lanes[:-1])))
    bounds = np.append(begins[lane_at], len(text))
    order = suffix_orders(symbols, bounds)
    of = np.repeat(np.arange(len(contents)), lens + 1)
    shift = np.arange(len(text)) - begins[of]
    lane = np.repeat(lanes, lens + 1)
    at = order[shift[order] <= lens[of[order]] - width]  # strings, in ascending order within each lane
    words = np.ndarray(len(text), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,))  # eight bytes from each on
    new = np.ones(len(at), bool)
    a, b = at[:-1], at[1:]
    new[1:] = lane[a] != lane[b]
    for k in [*range(0, width - 7, 8), width - 8]:
        new[1:] |= words[a + k] != words[b + k]
    begin = np.flatnonzero(new)
    mask = np.zeros(len(contents), np.int64)
    if len(begin):
        doc = docs[of[at]]
        least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(at))))
        over = doc > least
        np.bitwise_or.at(mask, of[at[over]], np.int64(1) << shift[at[over]])
    return mask


def sorted_out(rows: pa.Table, width: int, most: int) -> tuple[pa.Table, pa.Table]:
    """(replies, left) of all rows of some groups: ``left`` are those of groups of more than ``most`` different stretches."""
    replies, rows = _settled(rows, width)
    gram, name = rows.column("gram").to_numpy(), rows.column("name").to_numpy()
    if not len(gram):
        return replies, rows
    first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])))
    part = np.cumsum(first) - 1  # of a row: its stretch
    own = gram[first]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    parts = np.repeat(np.diff(np.append(begin, len(own))), np.diff(np.append(begin, len(own))))
    many = (parts > most)[part]
    left = rows.filter(pa.array(many))
    use = np.flatnonzero((parts > 1) & (parts <= most))
    chosen = rows.select(["content", "doc_id"]).take(np.flatnonzero(first)[use])
    docs, sizes = chosen.column("doc_id").to_numpy(), np.array(pa.compute.binary_length(chosen.column("content").combine_chunks()), np.int64) + 1
    masks = np.zeros(len(own), np.int64)
    ends = np.cumsum(sizes)
    # A group lies whole in a lane, and lanes of one length are sorted together.
    group = own[use]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[: len(group)])
    lane, filled, lanes = 0, 0, np.zeros(len(group), np.int64)
    for i, j in zip(starts, np.append(starts[1:], len(group)), strict=False):
        size = int(ends[j - 1] - (ends[i - 1] if i else 0))
        if filled and filled + size > LANE:
            lane, filled = lane + 1, 0
        lanes[i:j], filled = lane, filled + size
    i = 0
    while i < len(group):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LANES, "right"))
        j = len(group) if j >= len(group) else max(int(np.searchsorted(lanes, lanes[j], "left")), int(np.searchsorted(lanes, lanes[i], "right")))
        masks[use[i:j]] = _equal_strings(chosen.column("content").slice(i, j - i).to_pylist(), docs[i:j], lanes[i:j], width)
        i = j
    mask = masks[part] << rows.column("shift").to_numpy().astype(np.int64)
    hit = pa.array(mask != 0)
    more = pa.table({"doc_id": rows.column("doc_id").filter(hit), "root": rows.column("root").filter(hit), "mask": pa.array(mask).filter(hit)})
    return pa.concat_tables([replies.cast(more.schema), more]), left


_FIELDS = pa.schema([("gram", pa.int64()), ("name", pa.int64()), ("content", pa.binary()), ("doc_id", pa.int64()), ("root", pa.int64()), ("shift", pa.int32()), ("mask", pa.int64())])


def _both(replies: pa.Table, rows: pa.Table) -> list[pa.RecordBatch]:
    """Replies and rows that are left in one form: a reply has a mask, and a string that is known by its name has no content."""
    out = [pa.table({f.name: t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in _FIELDS}) for t in (replies, rows)]
    return [b for t in out for b in t.to_batches(PIECE)]


def first_parts(docs: DataFrame, gram: int, width: int) -> DataFrame:
    """Stretches of documents (doc_id, text, grams) whose gram is among ``grams``; equal ones of a batch are settled at once.

    Those of frequent grams are cut into their strings, which go on by name alone.
    """

    def cut_out(batches):
        for batch in batches:
            yield from _cut_out(batch, gram, width)

    return docs.mapInArrow(cut_out, ROWS)


def _cut_out(batch: pa.RecordBatch, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """``first_parts`` of a batch. Bytes are copied last, of those stretches that are left, some at a time."""
    ids, data, offsets = _docs(batch)
    found = list(_wanted(batch, data, offsets, gram, width))
    if not found:
        return
    text, start, many, own, name, hot = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = ids[text]
    order, over = _order(own, name, doc)
    d, g, n = doc[order], own[order], name[order]
    once = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])))[: len(d)]
    gone = order[once & over]
    yield from _both(_replies(doc[gone], name[gone], np.zeros(len(gone), np.int32), many[gone]), _FIELDS.empty_table())
    left = order[once & ~over]
    for i in range(0, len(left), PIECE):
        at = left[i : i + PIECE]
        rows = pa.table({"gram": own[at], "name": name[at], "content": contents(data, start[at], many[at], width), "doc_id": doc[at], "root": name[at], "shift": np.zeros(len(at), np.int32)})
        frequent = pa.array(hot[at])
        yield from _both(_FIELDS.empty_table(), rows.filter(pa.compute.invert(frequent)))
        yield from _finer(rows.filter(frequent), width, width)


def _wanted(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, gram: int, width: int):
    """``stretches`` of a batch's texts, those whose gram is in the row's ``grams``, and whether it is a frequent one."""
    lists = batch.column("grams")
    of, values = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()
    grams, hot = values.field("gram").to_numpy(), values.field("hot").to_numpy(zero_copy_only=False)
    order = np.lexsort((grams, of))
    of, grams, hot = of[order], grams[order], hot[order]
    begin = np.searchsorted(of, np.arange(len(lists) + 1))
    known = np.unique(grams)
    for t, s, n, g, name in stretches(data, offsets, gram, width):
        keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g) if len(known) else np.zeros(0, np.int64)
        t, s, n, g, name = t[keep], s[keep], n[keep], g[keep], name[keep]
        at = np.full(len(t), -1)
        for i in np.unique(t):
            a, b = np.searchsorted(t, (i, i + 1))
            if begin[i + 1] > begin[i]:
                found = begin[i] + np.minimum(np.searchsorted(grams[begin[i] : begin[i + 1]], g[a:b]), begin[i + 1] - begin[i] - 1)
                at[a:b] = np.where(grams[found] == g[a:b], found, -1)
        keep = at >= 0
        yield t[keep], s[keep], n[keep], g[keep], name[keep], hot[at[keep]]


def _finer(rows: pa.Table, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """Stretches cut by longer grams; of length ``width``, into their strings, by name alone. Equal ones of ``rows`` are settled at once."""
    content = rows.column("content").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    data, offsets = np.frombuffer(content.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    doc, root, shift = (rows.column(c).to_numpy() for c in ("doc_id", "root", "shift"))
    for t, s, n, g, names in stretches(data, offsets, gram, width, single=gram == width):
        place = (shift[t] + s - offsets[t]).astype(np.int32)
        order, over = _order(g, names, doc[t])
        gone, left = order[over], order[~over]
        found = {"gram": g[left], "name": names[left], "doc_id": doc[t[left]], "root": root[t[left]], "shift": place[left]}
        if gram < width:
            found["content"] = contents(data, s[left], n[left], width)
        yield from _both(_replies(doc[t[gone]], root[t[gone]], place[gone], n[gone]), pa.table(found))


def finer_parts(parts: DataFrame, gram: int, width: int) -> DataFrame:
    return parts.mapInArrow(lambda batches: (x for b in batches for x in _finer(pa.table(b), gram, width)), ROWS)


def repeated(docs: DataFrame, groups: int, width: int, group_parts: int) -> DataFrame:
    """(doc_id, root, mask): strings of ``docs`` (doc_id, text, grams) that a smaller doc_id holds, by the stretches they lie in."""

    def sort_group(table: pa.Table) -> pa.Table:
        ready = pa.compute.is_null(table.column("content"))
        done, found = table.filter(ready), table.filter(pa.compute.invert(ready))
        return pa.concat_tables([done.select(_FIELDS.names).cast(_FIELDS), pa.Table.from_batches(_both(*sorted_out(found, width, group_parts)), _FIELDS)])

    found, tables = first_parts(docs, GRAMS[0], width), []
    for level in range(len(GRAMS)):
        part = F.pmod(F.when(F.col("content").isNull(), F.xxhash64("doc_id", "root", "shift")).otherwise(F.col("gram")), F.lit(groups))
        done = saved(found.withColumn("part", part).groupBy("part").applyInArrow(sort_group, ROWS))
        tables.append(done.where("content is null"))
        found = finer_parts(done.where("content is not null"), GRAMS[level + 1] if level + 1 < len(GRAMS) else width, width)
    tables.append(saved(found))
    settled = reduce(DataFrame.unionByName, tables)
    # Strings of their own: those of a name are equal.
    rows = settled.where("mask is null").select("gram", "name", "doc_id", "root", "shift")
    least = cut(rows.groupBy("gram", "name").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")))
    total = least.agg(F.sum("many")).first()[0] or 0
    over = join_frequent(rows, least, ["gram", "name"], "many", total).where("doc_id > least")
    return settled.where("mask is not null").select("doc_id", "root", "mask").unionByName(over.selectExpr("doc_id", "root", "shiftleft(1L, shift) as mask"))


#: What ``cleaned`` gives of each row.
CLEANED = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def cleaned(docs: DataFrame, gram: int, width: int) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, grams, replies) without its repeated bytes."""

    def spans_of(data, offsets, batch):
        gone = np.zeros(len(data) + 1, np.int32)
        lists = batch.column("replies")
        of, values = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()
        root, mask = values.field("root").to_numpy(), values.field("mask").to_numpy()
        order = np.lexsort((root, of))
        of, root, mask = of[order], root[order], mask[order]
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (root[1:] != root[:-1])))[: len(of)])
        if len(first):
            of, root, mask = of[first], root[first], np.bitwise_or.reduceat(mask, first)
        begin = np.searchsorted(of, np.arange(len(lists) + 1))
        for t, s, n, _, name, _ in _wanted(batch, data, offsets, gram, width):
            own = np.zeros(len(t), np.int64)
            for i in np.unique(t):
                a, b = np.searchsorted(t, (i, i + 1))
                names = root[begin[i] : begin[i + 1]]
                if len(names):
                    at = np.minimum(np.searchsorted(names, name[a:b]), len(names) - 1)
                    own[a:b] = np.where(names[at] == name[a:b], mask[begin[i] + at], 0)
            for k in range(RUN):
                hit = s[(own >> k) & 1 == 1] + k
                gone[hit] += 1
                gone[hit + width] -= 1
        covered = np.zeros(len(data) + 2, bool)
        np.cumsum(gone, out=gone)
        covered[1:-1] = gone[:-1] > 0
        return covered

    def clean(batches):
        for batch in batches:
            _, data, offsets = _docs(batch)
            covered = spans_of(data, offsets, batch)
            rows = []
            for doc, i, j in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = covered[i + 1 : j + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                rows.append({"doc_id": doc, "n_bytes": j - i, "n_removed": int(own.sum()), "spans": spans, "kept": data[i:j][~own].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, CLEAN_SCHEMA)

    return docs.mapInArrow(clean, CLEANED)


CLEAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove(docs: DataFrame, width: int = WIDTH, group_rows: int = GROUP_ROWS, group_parts: int = GROUP_PARTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): each row of ``docs`` (doc_id, text) without the bytes of repeated strings.

    A byte goes if a string of ``width`` bytes over it also starts in a document of a smaller
    doc_id; strings are judged on the input. A null text is empty. Repeated rows, and rows of
    one doc_id with several texts, are kept beside each other: only a smaller id takes bytes
    away. Rows of a null doc_id take and lose none. Further columns are ignored, an empty table
    gives an empty one. ``width`` is over the last of GRAMS. Groups of
    over ``group_parts`` different stretches are cut by longer grams, those of over ``group_rows`` documents into strings.
    """
    docs = long_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.substring(F.sha2("text", 256), 1, 32)
    # Whole copies: the smallest id stands for all.
    keyed = cut(docs.where("doc_id is not null").select("doc_id", name.alias("name"), F.octet_length("text").alias("size")))
    copies = cut(keyed.groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1"))
    total, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    gone = join_frequent(keyed.where(f"size >= {width}"), copies, ["name"], "many", rows).where("doc_id > least").select("doc_id", "name").distinct()
    gone = bounded(gone)
    named_docs = docs.withColumn("name", name)
    whole = named_docs.join(gone, ["doc_id", "name"], "left_semi")
    rest = named_docs.join(gone, ["doc_id", "name"], "left_anti").drop("name")
    # What shares a gram with another document.
    groups = max((total or 0) >> 22, 2 * parts)
    pairs = saved(grams_shared(rest.where("doc_id is not null"), groups, GRAMS[0], width))
    hot = bounded(pairs.groupBy("gram").count().where(f"count > {group_rows}").select("gram", F.lit(True).alias("hot")))
    shared = pairs.join(hot, "gram", "left").groupBy("doc_id").agg(F.collect_set(F.struct("gram", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("grams"))
    some = rest.join(shared, "doc_id")
    replies = repeated(some, groups, width, group_parts)
    replies = replies.groupBy("doc_id").agg(F.collect_list(F.struct("root", "mask")).alias("replies"))
    done = cleaned(rest.where("doc_id is not null").join(shared.join(replies, "doc_id"), "doc_id", "left"), GRAMS[0], width)
    none = F.array().cast("array<struct<start:long,end:long>>")
    size = F.octet_length("text").cast("long")
    as_is = rest.where("doc_id is null").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    out = whole.select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
    return as_is.unionByName(out).unionByName(done)
