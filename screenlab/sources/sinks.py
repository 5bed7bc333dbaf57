"""Writers: JSON lines, lists, dictionaries, Markdown and workbooks."""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import assert_present, in_ranges, shared_folder
from . import packing


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", files: int = 0) -> None:
    """UTF-8 as it is, null members left out; ``mode`` "append" resumes."""
    (rows.coalesce(files) if files else rows).write.mode(mode).json(path)


def resumed(spark: SparkSession, path: str, append: bool) -> str:
    """The mode to write labels with; what is there already is only added to on demand."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and not append:
        raise ValueError(f"{path} is there already: say append to go on with it")
    return "append"


def split_sets(rows: DataFrame, path: str, listing: DataFrame | None = None) -> None:
    """K4: a folder for each value of ``split``, image paths as images/<leaf>.

    With ``listing`` (path, content) an image that is missing is an error, and the images of
    each set are copied to its folder.
    """
    name = F.try_element_at(F.split("image_path", "/"), F.lit(-1))
    if listing is not None:
        files = assert_present(rows.select("split", "image_path"), listing.select(F.col("path").alias("image_path")), "image_path")
        files = files.distinct().join(listing.withColumnRenamed("path", "image_path"), "image_path")
        image_files(files.select(F.concat("split", F.lit("/images/"), name).alias("name"), "content"), path)
    rows.withColumn("image_path", F.concat(F.lit("images/"), name)).write.mode("append").partitionBy("split").json(path)


def image_files(rows: DataFrame, folder: str) -> int:
    """Each (name, content) as a file below ``folder``, any that pyarrow's file systems know; how many there are.

    A file is written beside its place and then moved, so a task that runs again leaves whole files.
    """

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(names)], pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tab_list(rows: DataFrame, path: str, *columns: str) -> None:
    """K5, K6: fields with tabs between, unquoted."""
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)


def dictionary(chars: DataFrame, path: str) -> None:
    """K7: one character a line in code-point order; a character set is small by nature."""
    chars.select(F.col("ch").alias("value")).distinct().orderBy("value").coalesce(1).write.text(path)


def coverage(counts: DataFrame, per_source: DataFrame) -> str:
    """K7: the coverage document from (language, ch, n) and (source, n)."""
    total = counts.groupBy("ch").agg(F.sum("n").alias("n"))
    doc = {
        "total_unique_chars": total.count(),
        "samples_per_source": {r["source"]: r["n"] for r in per_source.collect()},
        "per_language_unique_chars": {r["language"]: r["k"] for r in counts.groupBy("language").agg(F.count_distinct("ch").alias("k")).orderBy("language").collect()},
        "top_50_global": [[r["ch"], r["n"]] for r in total.orderBy(F.desc("n"), "ch").limit(50).collect()],
    }
    return json.dumps(doc, ensure_ascii=False, indent=2)


def markdown(header: list[str], rows: Iterable[tuple]) -> str:
    """K9: a table; rates (floats) in percent with one decimal."""
    show = lambda v: f"{v * 100:.1f}%" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


#: Rows of a sheet, fills of the verdicts in a workbook, columns and their widths, and the height of a row with pictures.
SHEET_ROWS = 1_048_576
FILLS = {"PASS": "C6EFCE", "WARN": "FFEB9C", "FAIL": "FFC7CE"}
COLUMNS = {"#": 5, "Filename": 30, "Test image": 38, "Test text": 42, "Reference image": 38, "Reference text": 42, "CER": 10, "WER": 10, "Verdict": 12}
ROW_POINTS = 125
#: English metric units in a pixel.
EMU = 9525
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
TYPE = "application/vnd.openxmlformats-officedocument"


def cell(value, style: int = 0) -> str:
    if isinstance(value, int | float):
        return f'<c s="{style}"><v>{value}</v></c>'
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def relation(number: int, kind: str, target: str) -> str:
    return f'<Relationship Id="r{number}" Type="{REL}/{kind}" Target="{target}"/>'


def relations(*pairs: tuple[str, str]) -> str:
    """A part's relations r1, r2, ... to (kind, target)."""
    items = "".join(relation(k, *pair) for k, pair in enumerate(pairs, 1))
    return f'<Relationships xmlns="{PACKAGE}/relationships">{items}</Relationships>'


def picture(number: int, column: int, row: int, png: bytes) -> str:
    """A picture at the corner of a cell, in its own size."""
    w, h = struct.unpack(">II", png[16:24])
    at = f"<xdr:from><xdr:col>{column}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>"
    size = f'cx="{w * EMU}" cy="{h * EMU}"'
    fill = f'<xdr:blipFill><a:blip r:embed="r{number}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill>'
    shape = f'<xdr:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr>'
    name = f'<xdr:nvPicPr><xdr:cNvPr id="{number}" name="p{number}"/><xdr:cNvPicPr/></xdr:nvPicPr>'
    return f"<xdr:oneCellAnchor>{at}<xdr:ext {size}/><xdr:pic>{name}{fill}{shape}</xdr:pic><xdr:clientData/></xdr:oneCellAnchor>"


#: Rows that are packed as one block of a sheet, and rows with pictures that a worker holds at a time.
BLOCK_ROWS, PICTURE_ROWS = 1000, 200
#: A piece of the file: of the sheet, of the drawing or its relations a packed block, of the media a picture.
PIECE = "part int, seq int, kind string, name string, plain long, packed long, crc long, data binary"
_PIECE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("plain", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("data", pa.binary())])


def sheet_pieces(rows: DataFrame, images: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """K8: the rows of a sheet, its drawing and its pictures, packed where they are; numbers go on from range to range."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if images and not 0 < int(conf.get(key)) <= PICTURE_ROWS:
        conf.set(key, PICTURE_ROWS)
    style, tall = {v: k + 2 for k, v in enumerate(FILLS)}, f' ht="{ROW_POINTS}" customHeight="1"' if images else ""
    shown = sum((F.when(F.octet_length(c) > 0, 1).otherwise(0) for c in images), F.lit(0))
    placed = in_ranges(rows.withColumn("_all", F.lit(0)), ["_all"], ["row", "filename"], {"_count_rows": F.count("*"), "_sum_shown": F.sum(shown)})

    def pack(batches):
        part, held, n, k, seq = None, {"sheet": [], "drawing": [], "relations": []}, 0, 0, 0

        def flush():
            nonlocal seq
            out = []
            for kind, lines in held.items():
                if lines:
                    block, data = packing.deflated("".join(lines).encode())
                    out.append({"part": part, "seq": seq, "kind": kind, "name": None, "plain": block.plain, "packed": block.packed, "crc": block.crc, "data": data})
                    lines.clear()
            seq += 1
            return out

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_part"] != part:
                    out += flush()
                    part, n, k, seq = r["_part"], r["_count_rows"] or 0, r["_sum_shown"] or 0, 0
                n += 1
                values = [n, r["filename"], "", r["test_text"] or "", "", r["ref_text"] or "", round(r["cer"], 4), round(r["wer"], 4)]
                held["sheet"].append(f"<row{tall}>{''.join(map(cell, values))}{cell(r['verdict'], style[r['verdict']])}</row>")
                for c in images:
                    if r[c]:
                        k += 1
                        held["drawing"].append(picture(k, COLUMN_OF[c], n, r[c]))
                        held["relations"].append(relation(k, "image", f"../media/p{k}.png"))
                        out.append({"part": part, "seq": seq, "kind": "media", "name": f"xl/media/p{k}.png", "plain": len(r[c]), "packed": len(r[c]), "crc": zlib.crc32(r[c]), "data": r[c]})
                if len(held["sheet"]) >= block_rows:
                    out += flush()
            yield pa.RecordBatch.from_pylist(out, _PIECE)
        yield pa.RecordBatch.from_pylist(flush(), _PIECE)

    fields = ["row", "filename", "test_text", "ref_text", "cer", "wer", "verdict", *images, "_part", "_count_rows", "_sum_shown"]
    return placed.select(*fields).repartition("_part").sortWithinPartitions("_part", "row", "filename").mapInArrow(pack, PIECE)


def workbook_chunks(rows: DataFrame, only_test: list[str] = (), only_reference: list[str] = (), block_rows: int = BLOCK_ROWS) -> Iterator[bytes]:
    """K8: the bytes of ``workbook``, as they are put together: the driver holds a partition of packed pieces and the directory."""
    images = [c for c in ("test_png", "ref_png") if c in rows.columns]
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/pieces-{uuid.uuid4().hex}"
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in FILLS]
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("cer"), F.coalesce(F.avg("wer"), F.lit(0.0)).alias("wer"), *counts).first()
    if known["n"] >= SHEET_ROWS:
        raise ValueError(f"{known['n']} rows are more than a sheet holds")
    sheet_pieces(rows, images, block_rows).write.parquet(path)
    pieces, archive = spark.read.schema(PIECE).parquet(path), packing.Archive()

    def put(name: str, kind: str, head: str, foot: str) -> Iterator[bytes]:
        """An entry of all blocks of a kind between head and foot."""
        own = pieces.where(F.col("kind") == kind)
        first, last = packing.deflated((HEAD + head).encode()), packing.deflated(foot.encode())
        total = first[0]
        for r in own.select("plain", "packed", "crc", "part", "seq").orderBy("part", "seq").collect():  # a row for many rows of the sheet
            total = packing.joined(total, packing.Block(r["plain"], r["packed"], r["crc"]))
        total = packing.joined(packing.joined(total, last[0]), packing.Block(0, len(packing.LAST_BLOCK), 0))
        blocks = (bytes(r["data"]) for r in own.orderBy("part", "seq").select("data").toLocalIterator())
        yield from archive.entry(name, total, 8, itertools.chain((first[1],), blocks, (last[1], packing.LAST_BLOCK)))

    widths = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(COLUMNS.values(), 1))
    panes = '<sheetViews><sheetView workbookViewId="0"><pane xSplit="2" ySplit="1" topLeftCell="C2" state="frozen"/></sheetView></sheetViews>'
    head = f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{panes}<cols>{widths}</cols><sheetData><row>{"".join(cell(h, 1) for h in COLUMNS)}</row>'
    yield from put("xl/worksheets/sheet1.xml", "sheet", head, "</sheetData>" + '<drawing r:id="r1"/>' * bool(images) + "</worksheet>")
    if images:
        yield from put("xl/drawings/drawing1.xml", "drawing", f'<xdr:wsDr xmlns:xdr="{DRAWING}/spreadsheetDrawing" xmlns:a="{DRAWING}/main" xmlns:r="{REL}">', "</xdr:wsDr>")
        yield from put("xl/drawings/_rels/drawing1.xml.rels", "relations", f'<Relationships xmlns="{PACKAGE}/relationships">', "</Relationships>")
        for r in pieces.where("kind = 'media'").toLocalIterator():
            yield from archive.entry(r["name"], packing.Block(r["plain"], r["packed"], r["crc"]), 0, iter((bytes(r["data"]),)))
    facts = [("Pairs", known["n"]), *((v, known[v]) for v in FILLS), ("Mean CER", round(known["cer"], 4)), ("Mean WER", round(known["wer"], 4)), ("Only in test", len(only_test)), ("Only in reference", len(only_reference))]
    facts += [("Only in test", x) for x in only_test] + [("Only in reference", x) for x in only_reference]
    parts = {
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(f"<row>{cell(k, 1)}{cell(v)}</row>" for k, v in facts)}</sheetData></worksheet>',
        "_rels/.rels": relations(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Results" sheetId="1" r:id="r1"/><sheet name="Summary" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"), ("styles", "styles.xml")),
        "xl/styles.xml": styles(),
    }
    types = {"xl/workbook.xml": "sheet.main", "xl/styles.xml": "styles", "xl/worksheets/sheet1.xml": "worksheet", "xl/worksheets/sheet2.xml": "worksheet"}
    named = {k: f"{TYPE}.spreadsheetml.{v}+xml" for k, v in types.items()}
    if images:
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = relations(("drawing", "../drawings/drawing1.xml"))
        named["xl/drawings/drawing1.xml"] = f"{TYPE}.drawing+xml"
    kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/>'
    parts["[Content_Types].xml"] = f'<Types xmlns="{PACKAGE}/content-types">{kinds}{"".join(f"""<Override PartName="/{k}" ContentType="{v}"/>""" for k, v in named.items())}</Types>'
    for name, text in parts.items():
        yield from archive.text(name, HEAD + text)
    yield from archive.end()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def workbook(rows: DataFrame, only_test: list[str] = (), only_reference: list[str] = ()) -> bytes:
    """K8: results (header, frozen panes, coloured verdicts, thumbnails), summary and unmatched names as an .xlsx file.

    ``rows``: row, filename, test_text, ref_text, cer, wer, verdict in report order, and
    maybe test_png and ref_png (``imaging.thumbnails``). Executors pack rows and pictures; more
    rows than a sheet can hold are an error.
    """
    return b"".join(workbook_chunks(rows, only_test, only_reference))


def write_workbook(rows: DataFrame, path: str, only_test: list[str] = (), only_reference: list[str] = ()) -> int:
    """K8: ``workbook`` as a file in any file system that Spark writes, never whole in memory; its bytes are counted."""
    spark, size = rows.sparkSession, 0
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        for chunk in workbook_chunks(rows, only_test, only_reference):
            out.write(bytearray(chunk))
            size += len(chunk)
    finally:
        out.close()
    return size


#: Where the pictures stand.
COLUMN_OF = {"test_png": 2, "ref_png": 4}


def styles() -> str:
    """Plain cells, bold heads, and a fill for each verdict."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    own = "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in range(2, 2 + len(FILLS)))
    return (
        f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{2 + len(FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(FILLS)}"><xf/><xf fontId="1" applyFont="1"/>{own}</cellXfs></styleSheet>'
    )
