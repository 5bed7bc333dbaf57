"""Zip archives in parts: neither an archive nor an entry has to fit into a task.

Spark's text source cuts an archive wherever the bytes "PK" stand, as they do before each
entry, and so deals it over tasks by bytes, in any file system that Spark reads. Lengths give
each piece its place in the archive; the end of the archive names its directory, the
directory its entries; pieces meet the entries that they overlap, and each entry is inflated
piece by piece.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.imaging import readable
from ..functions.text import casefold, leaf, stem
from ..operators.relate import small
from . import schema

#: Where pieces end, and how far from an archive's end its directory is named: a comment, and what stands before it.
CUT, TAIL = b"PK", 66_000
#: Bytes by which pieces and entries are brought together, pieces that a worker holds at a time, and bytes that are inflated at a time.
CELL, PIECES, STEP = 1 << 20, 256, 1 << 20
#: Bytes of the longest entry that is given as a row.
MOST_ENTRY = 1 << 28
#: Fixed values of the format: what stands in the directory before an entry's name, and before its data.
DIRECTORY, LOCAL = "<4s4B4HL2L5H2L", "<4s2B4HL2L2H"


def is_image_entry(name: Column) -> Column:
    """A leaf that is no dot-file and has the extension of an image."""
    return (name != "") & ~name.startswith(".") & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*schema.IMAGE_TYPES)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(archive, size, at, bytes): all bytes of the files, cut behind every "PK"; ``at`` is a piece's place in its file."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= PIECES:
        conf.set(key, PIECES)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", CUT.decode()).text(path).select(F.col("value").cast("binary").alias("bytes"), meta["file_path"].alias("archive"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for key in zip(batch.column("archive").to_pylist(), batch.column("block").to_pylist(), pa.compute.binary_length(batch.column("bytes")).to_pylist(), strict=True):
                at = at if key[:2] == last else 0
                last = key[:2]
                places.append(at)
                at += key[2] + len(CUT)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "rest"])

    placed = lines.mapInArrow(place, "bytes binary, archive string, block long, size long, rest long")
    # Blocks follow each other, and so do their pieces; a file has as many blocks as Spark cuts it into.
    ends = placed.groupBy("archive", "block").agg(F.max(F.col("rest") + F.octet_length("bytes") + len(CUT)).alias("many"))
    base = F.coalesce(F.sum("many").over(Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = placed.join(small(ends.select("archive", "block", base.alias("base"))), ["archive", "block"])
    at = F.col("base") + F.col("rest")
    whole = F.concat("bytes", F.lit(CUT))
    return based.select("archive", "size", at.alias("at"), F.substring(whole, F.lit(1), F.least(F.octet_length(whole).cast("long"), F.col("size") - at).cast("int")).alias("bytes")).where("octet_length(bytes) > 0")


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the directory of an archive lies, from its last pieces; no row if it names none."""
    pdf = pdf.sort_values("at")
    data, base = b"".join(pdf["bytes"]), int(pdf["at"].iloc[0])
    out = pd.DataFrame({"archive": pdf["archive"].iloc[:1], "start": 0, "stop": 0, "shift": 0})
    at = data.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack("<H", data[at + 20 : at + 22])[0] > len(data)):
        at = data.rfind(b"PK\5\6", 0, at)
    if at < 0:
        return out[:0]
    many, begin = struct.unpack("<2L", data[at + 12 : at + 20])
    stop = at
    if data[at - 20 : at - 16] == b"PK\6\7" and data[at - 76 : at - 72] == b"PK\6\6":
        many, begin = struct.unpack("<2Q", data[at - 36 : at - 20])
        stop = at - 76
    start = base + stop - many
    return out.assign(start=start, stop=base + stop, shift=start - begin)


_ENTRY = "archive string, ordinal long, name string, flags int, method int, crc long, packed long, length long, head long, stop long"


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entries that the pieces of a directory name, each with the place of its head and of what follows it."""
    pdf = pdf.sort_values("at")
    start, stop, shift = (int(pdf[c].iloc[0]) for c in ("start", "stop", "shift"))
    data, at, rows = b"".join(pdf["bytes"])[start - int(pdf["at"].iloc[0]) :][: stop - start], 0, []
    fixed = struct.calcsize(DIRECTORY)
    while data[at : at + 4] == b"PK\1\2" and at + fixed <= len(data):
        h = struct.unpack(DIRECTORY, data[at : at + fixed])
        flags, method, crc, packed, length, n, extra, comment, head = h[5], h[6], h[9], h[10], h[11], h[12], h[13], h[14], h[18]
        name, more = data[at + fixed : at + fixed + n], data[at + fixed + n : at + fixed + n + extra]
        while len(more) >= 4:  # large numbers stand apart
            kind, size = struct.unpack("<2H", more[:4])
            own, more = more[4 : 4 + size], more[4 + size :]
            if kind == 1:
                for what in ("length", "packed", "head"):
                    now = {"length": length, "packed": packed, "head": head}[what]
                    if now == 0xFFFFFFFF and len(own) >= 8:
                        (now,), own = struct.unpack("<Q", own[:8]), own[8:]
                    length, packed, head = (now if what == k else v for k, v in (("length", length), ("packed", packed), ("head", head)))
        rows.append((len(rows), name.decode("utf-8" if flags & 0x800 else "cp437", "replace").partition("\0")[0], flags, method, crc, packed, length, head + shift))
        at += fixed + n + extra + comment
    out = pd.DataFrame(rows, columns=["ordinal", "name", "flags", "method", "crc", "packed", "length", "head"]).sort_values("head")
    out["stop"] = [*out["head"][1:], start] if len(out) else []
    return out.assign(archive=pdf["archive"].iloc[0])[["archive", "ordinal", "name", "flags", "method", "crc", "packed", "length", "head", "stop"]]


class Entry:
    """An entry that is inflated as its pieces come; of one that is too long only the checks go on."""

    def __init__(self, row: dict, most: int):
        self.row, self.most, self.head, self.left = row, most, b"", row["packed"]
        self.kept, self.length, self.crc, self.ok = [], 0, 0, not row["flags"] & 1 and row["method"] in (0, 8, 12)
        self.unpack = {8: lambda: zlib.decompressobj(-15), 12: bz2.BZ2Decompressor}.get(row["method"], lambda: None)()

    def feed(self, data: bytes) -> None:
        if self.ok and self.head is not None:
            self.head += data
            if len(self.head) < 30:
                return
            h = struct.unpack(LOCAL, self.head[:30])
            if h[0] != b"PK\3\4":
                self.ok = False
            if len(self.head) < 30 + h[-2] + h[-1]:
                return
            data, self.head = self.head[30 + h[-2] + h[-1] :], None
        if not self.ok:
            return
        data, self.left = data[: self.left], self.left - min(self.left, len(data))
        try:
            if self.unpack is None:
                self.take(data)
            while self.unpack is not None and data and not self.unpack.eof:
                self.take(self.unpack.decompress(data, STEP))
                data = self.unpack.unconsumed_tail if self.row["method"] == 8 else b"" if self.unpack.needs_input else data[:0]
                while self.row["method"] == 12 and not self.unpack.eof and not self.unpack.needs_input:
                    self.take(self.unpack.decompress(b"", STEP))
        except (zlib.error, OSError, EOFError):
            self.ok = False

    def take(self, data: bytes) -> None:
        self.crc, self.length = zlib.crc32(data, self.crc), self.length + len(data)
        if self.length <= self.most:
            self.kept.append(data)
        else:
            self.kept = []

    def content(self) -> bytes | None:
        """The whole content, if it is whole and not too long."""
        if self.unpack is not None and self.ok and not self.unpack.eof:
            try:
                self.take(self.unpack.flush() if self.row["method"] == 8 else b"")
            except zlib.error:
                return None
        whole = self.ok and self.head is None and not self.left and (self.unpack is None or self.unpack.eof) and self.crc == self.row["crc"] and self.length == self.row["length"]
        return b"".join(self.kept) if whole and self.length <= self.most else None


def archive_entries(spark: SparkSession, path: str, most: int = MOST_ENTRY) -> DataFrame:
    """(archive, ordinal, entry_path, display_name, stem, content) of the images in zip files.

    Entries that cannot be inflated, whose checksum or length is wrong, or that are no whole image
    are left out, so they pair with nothing; so are encrypted ones and those of over ``most`` bytes,
    which are read through without being held. Files that are no archive have no entries. A
    stretch of 2 GB without the bytes "PK" is an error of Spark's text source.
    """
    found = pieces(spark, path)
    ends = found.where(F.col("at") + F.octet_length("bytes") > F.col("size") - TAIL).groupBy("archive").applyInPandas(_ends, "archive string, start long, stop long, shift long")
    listed = found.join(small(ends), "archive").where((F.col("at") < F.col("stop")) & (F.col("at") + F.octet_length("bytes") > F.col("start")))
    entries = listed.groupBy("archive").applyInPandas(_entries, _ENTRY)
    entries = entries.withColumn("display_name", leaf(F.col("name"))).where(~F.col("name").endswith("/") & is_image_entry(F.col("display_name")) & (F.col("stop") > F.col("head")))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor((b - 1) / CELL)))
    first = lambda a: F.floor(F.col(a) / CELL)
    p = found.withColumn("end", F.col("at") + F.octet_length("bytes")).withColumn("cell", cells(F.col("at"), F.col("end")))
    e = entries.withColumn("cell", cells(F.col("head"), F.col("stop")))
    met = p.join(e, ["archive", "cell"]).where((F.col("at") < F.col("stop")) & (F.col("end") > F.col("head")) & (F.col("cell") == F.greatest(first("at"), first("head"))))
    skip = F.greatest(F.col("head") - F.col("at"), F.lit(0)).cast("int")
    met = met.select("archive", "ordinal", "name", "display_name", "flags", "method", "crc", "packed", "length", "at", F.substring("bytes", skip + 1, (F.least("stop", "end") - F.col("at")).cast("int") - skip).alias("bytes"))
    fields = ["archive", "ordinal", "name", "display_name"]

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = None

        def done():
            content = entry.content()
            if content is not None and readable(content):
                yield pa.RecordBatch.from_arrays([*(pa.array([entry.row[c]]) for c in fields), pa.array([content], pa.binary())], [*fields, "content"])

        for batch in batches:
            for row in batch.to_pylist():
                if entry is None or (row["archive"], row["ordinal"]) != (entry.row["archive"], entry.row["ordinal"]):
                    if entry is not None:
                        yield from done()
                    entry = Entry({k: v for k, v in row.items() if k != "bytes"}, most)
                entry.feed(row["bytes"])
        if entry is not None:
            yield from done()

    sorted_ = met.repartition("archive", "ordinal").sortWithinPartitions("archive", "ordinal", "at")
    out = sorted_.mapInArrow(inflate, "archive string, ordinal long, name string, display_name string, content binary")
    return out.select("archive", "ordinal", F.col("name").alias("entry_path"), "content", "display_name", casefold()(stem(F.col("display_name"))).alias("stem"))
