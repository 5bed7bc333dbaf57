"""Zip files of packed parts, and workbooks that executors pack."""

import io
import random
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.functions import imaging
from screenlab.sources import packing, sinks


def test_checksums_of_joined_blocks():
    rng = random.Random(2)
    for _ in range(60):
        parts = [rng.randbytes(rng.choice([0, 1, 7, 1000, 70_000])) for _ in range(rng.randrange(1, 6))]
        total, data = packing.Block(0, 0, 0), b""
        for p in parts:
            block, packed = packing.deflated(p)
            total, data = packing.joined(total, block), data + packed
        assert total == packing.Block(sum(map(len, parts)), len(data), zlib.crc32(b"".join(parts)))
        assert zlib.decompress(data + packing.LAST_BLOCK, -15) == b"".join(parts)


def test_archive_of_many_entries():
    """More than the short form of the directory counts."""
    archive, out = packing.Archive(), []
    for k in range(66_000):
        out += archive.entry(f"é{k}", packing.Block(1, 1, zlib.crc32(b"x")), 0, iter((b"x",)))
    out += archive.text("last", "text")
    out += archive.end()
    with zipfile.ZipFile(io.BytesIO(b"".join(out))) as z:
        assert len(z.namelist()) == 66_001 and z.read("last") == b"text" and z.read("é65999") == b"x" and z.testzip() is None


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_workbook_of_many_rows(spark, tmp_path, block_rows):
    png = [imaging.to_png(np.full((2, 3 + k), k, np.uint8)) for k in range(5)]
    verdicts = ["PASS", "WARN", "FAIL"]
    rows = [(i, f"n<{i}>.png", f"t{i}\n&é", None if i % 7 else "r", i / 1000, i / 500, verdicts[i % 3], png[i % 5] if i % 3 else None, png[i % 4] if i % 2 else b"") for i in range(1, 401)]
    df = spark.createDataFrame(rows, "row int, filename string, test_text string, ref_text string, cer double, wer double, verdict string, test_png binary, ref_png binary").repartition(7)
    data = b"".join(sinks.workbook_chunks(df, ["only&.png"], ["a", "b"], block_rows))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                ET.fromstring(z.read(name))
        space = {"m": sinks.MAIN}
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml")).findall(".//m:row", space)
        assert [[(c.findtext("m:v", None, space) or "".join(c.itertext())) for c in r] for r in sheet[1:]] == [[str(n), r[1], "", r[2], "", r[3] or "", str(round(r[4], 4)), str(round(r[5], 4)), r[6]] for n, r in enumerate(rows, 1)]
        shown = [(column, n, p) for n, r in enumerate(rows, 1) for column, p in ((2, r[7]), (4, r[8])) if p]
        assert [z.read(f"xl/media/p{k}.png") for k in range(1, len(shown) + 1)] == [p for _, _, p in shown]
        drawing = z.read("xl/drawings/drawing1.xml").decode()
        assert drawing.count("<xdr:pic>") == len(shown) == z.read("xl/drawings/_rels/drawing1.xml.rels").decode().count("<Relationship ")
        for k, (column, n, _) in enumerate(shown, 1):
            at = drawing.index(f'r:embed="r{k}"')
            anchor = drawing[drawing.rindex("<xdr:from>", 0, at) : at]
            assert f"<xdr:col>{column}</xdr:col>" in anchor and f"<xdr:row>{n}</xdr:row>" in anchor
        summary = z.read("xl/worksheets/sheet2.xml").decode()
        assert "only&amp;.png" in summary and "<v>400</v>" in summary
    assert sinks.write_workbook(df, f"{tmp_path}/out.xlsx", ["only&.png"], ["a", "b"]) == (tmp_path / "out.xlsx").stat().st_size
    assert zipfile.ZipFile(tmp_path / "out.xlsx").testzip() is None


def test_workbook_of_nothing(spark):
    none = spark.createDataFrame([], "row int, filename string, test_text string, ref_text string, cer double, wer double, verdict string, test_png binary")
    with zipfile.ZipFile(io.BytesIO(sinks.workbook(none))) as z:
        assert z.testzip() is None and z.read("xl/worksheets/sheet1.xml").decode().count("<row") == 1
        assert all(ET.fromstring(z.read(n)) is not None for n in z.namelist() if n.endswith((".xml", ".rels")))
