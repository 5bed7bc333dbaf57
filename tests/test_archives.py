"""Archives in parts: small splits, long and odd entries, and files that are none, against the standard library."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from screenlab.functions import imaging
from screenlab.sources import archives


def png(w, h, seed=0, level=None):
    return imaging.to_png(np.random.default_rng(seed).integers(0, 255, (h, w, 3)).astype(np.uint8))


def jpeg(scan=b"\x12\xff\x00\x34\xff\xd0\x56", frame=True, end=True):
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 9, 9, 1) + b"\x01\x11\x00"
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + sof * frame + b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9" * end


def webp(body=b"\x00" * 3 + b"\x9d\x01\x2a" + b"\x00" * 9, kind=b"VP8 "):
    chunk = kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def bmp(rows=3):
    return b"BM" + struct.pack("<LLL", 54 + 4 * rows, 0, 54) + struct.pack("<LllHHL", 40, 1, 3, 1, 24, 0) + b"\0" * 20 + b"\0" * 4 * rows


def tiff(at=8 + 2 + 48 + 4):
    fields = [(256, 3, 1, 2), (257, 3, 1, 2), (273, 4, 1, at), (279, 4, 1, 4)]
    return b"II*\0" + struct.pack("<L", 8) + struct.pack("<H", 4) + b"".join(struct.pack("<HHLL", *f) for f in fields) + b"\0" * 4 + b"\1\2\3\4"


def test_whole_images():
    good = [png(3, 2), jpeg(), webp(), webp(b"\x2f" + b"\0" * 9, b"VP8L"), bmp(), tiff()]
    assert all(map(imaging.readable, good))
    cut = [g[: len(g) - 3] for g in good]
    bad = [jpeg(frame=False), jpeg(end=False), jpeg(scan=b""), webp(b"\0" * 12), bmp(2), tiff(100), b"", b"\xff\xd8\xff\xd9", b"BM", b"RIFF", b"II*\0", b"no image"]
    assert not any(map(imaging.readable, cut + bad))


def expected(folder):
    out = []
    for path in sorted(folder.glob("*.zip")):
        try:
            z = zipfile.ZipFile(path)
        except zipfile.BadZipFile:
            continue
        for k, info in enumerate(z.infolist()):
            leaf = info.filename.rpartition("/")[2]
            if info.is_dir() or not leaf or leaf.startswith(".") or leaf.rpartition(".")[2].lower() not in "png jpg jpeg bmp webp tif tiff".split() or "." not in leaf:
                continue
            try:
                data = z.read(info)
            except (zipfile.BadZipFile, RuntimeError, OSError, zlib.error, NotImplementedError):
                continue
            if imaging.readable(data):
                out.append((path.name, k, info.filename, data))
    return sorted(out)


@pytest.mark.parametrize("split", ["7k", "100k", "128m"])
def test_entries_equal_the_library(spark, tmp_path, split):
    rng = random.Random(3)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(40):
            data = rng.choice([png(rng.randrange(1, 90), rng.randrange(1, 40), k), jpeg(b"PK\x03\x04" * 9 + b"PK" * 50), webp(), bmp(), tiff(), b"PK\5\6" + b"x" * 30])
            how = rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
            z.writestr(f"d{k % 3}/é{k}.{rng.choice(['PNG', 'jpg', 'webp', 'bmp', 'tiff', 'txt'])}", data, how)
        z.writestr("d/", b"")
        z.writestr("big.png", png(700, 300, 1), zipfile.ZIP_STORED)
        z.comment = b"a comment PK\1\2 with marks " + b"c" * 900
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    (tmp_path / "front.zip").write_bytes(b"a program stands before the archive PK\3\4 " + bytes(raw))
    raw[len(raw) // 3] ^= 0xFF
    (tmp_path / "hurt.zip").write_bytes(bytes(raw))
    (tmp_path / "cut.zip").write_bytes(bytes(raw[:5000]))
    (tmp_path / "none.zip").write_bytes(b"PK")
    (tmp_path / "empty.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "nothing.zip", "w"):
        pass
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z, z.open(zipfile.ZipInfo("x.png"), "w", force_zip64=True) as f:
        f.write(png(20, 20))
    (tmp_path / "large-numbers.zip").write_bytes(big.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = archives.archive_entries(spark, f"{tmp_path}/*.zip").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [e for e in expected(tmp_path) if zipfile.ZipFile(tmp_path / e[0]).infolist()[e[1]].compress_type != zipfile.ZIP_LZMA]
    assert sorted((r["archive"].rpartition("/")[2], r["ordinal"], r["entry_path"], bytes(r["content"])) for r in got) == want and len(want) > 60
    assert all(r["stem"] == r["display_name"].rpartition(".")[0].casefold() for r in got)


def test_an_entry_too_long_is_read_through(spark, tmp_path):
    """One of many pieces and a bomb of a few bytes: neither is held, the others are whole."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("bomb.png", b"\0" * 80_000_000, zipfile.ZIP_DEFLATED)
        z.writestr("long.png", png(900, 900, 5), zipfile.ZIP_STORED)
        z.writestr("good.png", png(9, 9), zipfile.ZIP_DEFLATED)
    assert [r["entry_path"] for r in archives.archive_entries(spark, f"{tmp_path}/a.zip", 1_000_000).collect()] == ["good.png"]
    entry = archives.Entry({"packed": 10, "flags": 0, "method": 8, "crc": 0, "length": 0}, 5)
    entry.feed(struct.pack(archives.LOCAL, b"PK\3\4", 0, 0, 0, 8, 0, 0, 0, 0, 0, 0, 0) + zlib.compress(b"a" * 99)[2:12])
    assert entry.kept == [] or sum(map(len, entry.kept)) <= 5
