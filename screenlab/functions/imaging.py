"""Image kernels on arrays (height x width [x BGR]); numpy inside a task, one image at a time."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preprocess:
    """Which stages run, and with what."""

    use_value: bool = True
    tophat: bool = True
    tophat_ratio: float = 0.12
    tophat_least: int = 15
    clahe: bool = True
    clip: float = 3.0
    tiles: int = 8
    invert: bool = True
    pad: int = 20


def to_gray(image: np.ndarray, use_value: bool = True) -> np.ndarray:
    """The largest channel, or luma; a gray image passes."""
    if image.ndim == 2:
        return image
    if use_value:
        return image.max(axis=2)
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    y = np.arange(size) - r
    dx = np.rint(r * np.sqrt(np.maximum(0, r * r - y * y)) / max(1, r)).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= dx[:, None]


def extreme(image: np.ndarray, mask: np.ndarray, high: bool) -> np.ndarray:
    """Largest or smallest value under the mask at each place; outside the image nothing counts."""
    r, edge = len(mask) // 2, 0 if high else 255
    windows = sliding_window_view(np.pad(image, r, constant_values=edge), mask.shape)
    out = np.full(image.shape, edge, np.uint8)
    for y, x in zip(*np.nonzero(mask), strict=True):
        (np.maximum if high else np.minimum)(out, windows[..., y, x], out=out)
    return out


def tophat(gray: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """What an opening with an ellipse of the image's scale removes."""
    size = max(least, round(gray.shape[0] * ratio) | 1) | 1
    mask = ellipse(size)
    return gray - np.minimum(gray, extreme(extreme(gray, mask, False), mask, True))


def equalize(gray: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited equalisation in tiles, bilinear between them."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            n[np.linspace(0, 255, over % 256, dtype=int)] += 1
            maps[i, j] = np.minimum(255, np.rint(np.cumsum(n) * 255.0 / (th * tw)))
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: maps[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], gray]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def stages(image: np.ndarray, config: Preprocess = Preprocess()) -> list[tuple[str, np.ndarray]]:
    """The image after each stage that is on."""
    gray = to_gray(image, config.use_value)
    out = [("gray", gray)]
    if config.tophat:
        out.append(("tophat", tophat(out[-1][1], config.tophat_ratio, config.tophat_least)))
    if config.clahe:
        out.append(("clahe", equalize(out[-1][1], config.clip, config.tiles)))
    if config.invert:
        out.append(("invert", 255 - out[-1][1]))
    if config.pad:
        out.append(("pad", np.pad(out[-1][1], config.pad, constant_values=255)))
    return out


STAGES = "array<struct<stage:string,height:int,width:int,data:binary>>"


def traced(config: Preprocess = Preprocess()):
    """A UDF from Spark's image struct to the gray image after each stage that is on; a null image has none."""

    def run(images: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, c, data in zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True):
            done = [] if data is None else stages(from_image_row(int(h), int(w), int(c), data), config)
            out.append([{"stage": n, "height": a.shape[0], "width": a.shape[1], "data": a.tobytes()} for n, a in done])
        return pd.Series(out)

    return F.pandas_udf(run, STAGES)


def last_stage(traces: Column) -> Column:
    """The result of the stages: the image after the last one."""
    return F.try_element_at(traces, F.lit(-1))


def to_png(image: np.ndarray) -> bytes:
    """An image (gray or BGR) as a PNG file."""
    rows = image if image.ndim == 2 else image[..., ::-1]
    h, w = rows.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def readable(data: bytes) -> bool:
    """Whether a file is a whole image: a PNG with right checksums and pixels, or another type whose parts a walk over them finds complete."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, pixels = 8, b""
        while at + 12 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
                return False
            pixels += body if kind == b"IDAT" else b""
            at += 12 + size
            if kind == b"IEND":
                try:
                    return bool(zlib.decompress(pixels))
                except zlib.error:
                    return False
        return False
    if data[:2] == b"\xff\xd8":
        return _whole_jpeg(data)
    if data[:2] == b"BM":
        return _whole_bmp(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _whole_webp(data)
    return data[:4] in (b"II*\x00", b"MM\x00*") and _whole_tiff(data)


def _whole_jpeg(data: bytes) -> bool:
    """A walk over the markers: a frame of some size, a scan, and the end, every segment within the file."""
    at, frame, scan = 2, False, False
    while at + 1 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # filling
            at += 1
        elif kind == 0xD9:
            return frame and scan
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                return False
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                parts = data[at + 9] if size > 7 else 0
                frame = parts > 0 and size == 8 + 3 * parts and int.from_bytes(data[at + 7 : at + 9], "big") > 0
            at += 2 + size
            if kind == 0xDA:  # up to the next marker that is neither a stuffed byte nor a restart
                scan, begin = True, at
                while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                    at += 2
                if at < 0 or at == begin:
                    return False
    return False


def _whole_bmp(data: bytes) -> bool:
    """Header and, where the pixels are not packed, all their rows."""
    if len(data) < 26:
        return False
    begin, head = struct.unpack("<2L", data[10:18])
    if head == 12:
        (width, height, _, bits), packing = struct.unpack("<4H", data[18:26]), 0
    elif head >= 40 and len(data) >= 34:
        width, height, _, bits, packing = struct.unpack("<2l2HL", data[18:34])
    else:
        return False
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return width > 0 and height != 0 and 14 + head <= begin < len(data) and (packing not in (0, 3) or begin + rows <= len(data))


def _whole_webp(data: bytes) -> bool:
    """A walk over the chunks: one holds a picture that begins as such, all lie within the file."""
    end, at, picture = 8 + int.from_bytes(data[4:8], "little"), 12, False
    if end > len(data):
        return False
    while at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            return False
        if kind == b"ANMF":
            at += 8 + 16  # its chunks follow
            continue
        body = data[at + 8 : at + 18]
        picture |= (kind == b"VP8 " and size >= 10 and body[3:6] == b"\x9d\x01\x2a") or (kind == b"VP8L" and size >= 5 and body[:1] == b"\x2f")
        at += 8 + size + size % 2
    return picture


def _whole_tiff(data: bytes) -> bool:
    """The first directory: sizes, and strips or tiles that lie within the file."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "L", data[4:8])[0] if len(data) >= 8 else 0
    if at < 8 or at + 2 > len(data):
        return False
    found = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        field = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(field) < 12:
            return False
        tag, kind, many = struct.unpack(order + "2HL", field[:8])
        size = {3: 2, 4: 4}.get(kind)
        if size:
            where = field[8:] if many * size <= 4 else data[(p := struct.unpack(order + "L", field[8:])[0]) : p + many * size]
            if len(where) < many * size:
                return False
            found[tag] = struct.unpack(f"{order}{many}{'H' if size == 2 else 'L'}", where[: many * size])
    for begins, sizes in ((273, 279), (324, 325)):
        if found.get(begins) and len(found[begins]) == len(found.get(sizes, ())):
            return all(found.get(t, (0,))[0] > 0 for t in (256, 257)) and all(a + n <= len(data) for a, n in zip(found[begins], found[sizes], strict=True))
    return False


def filled(polygons: list[list], width: int, height: int) -> np.ndarray:
    """A mask of the pixels whose centres lie in one of the polygons (points, even-odd rule), a scan line at a time.

    A line through the centres of a row crosses an edge if its ends lie on different sides, the
    upper end included; pixels between crossings one and two, three and four and so on are in.
    """
    mask = np.zeros((height, width), bool)
    for points in polygons:
        p = np.asarray(points, np.float64).reshape(-1, 2)
        if len(p) < 3 or not np.isfinite(p).all():
            continue
        (left, low), (right, high) = np.clip(np.floor(p.min(0)), 0, (width, height)).astype(int), np.clip(np.ceil(p.max(0)), 0, (width, height)).astype(int)
        if left >= right or low >= high:
            continue
        (x1, y1), (x2, y2) = p.T, np.roll(p, -1, 0).T
        y = np.arange(low, high)[:, None] + 0.5
        cut = (y1 <= y) != (y2 <= y)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.sort(np.where(cut, x1 + (y - y1) * (x2 - x1) / (y2 - y1), np.inf), 1)
        first = np.clip(np.ceil(np.minimum(x, right) - 0.5), left, right).astype(int) - left
        own, rows = np.zeros((high - low, right - left + 1), np.int32), np.arange(high - low)
        for k in range(0, int(cut.sum(1).max()), 2):  # changes along a row
            own[rows, first[:, k]] += 1
            own[rows, first[:, k + 1]] -= 1
        mask[low:high, left:right] |= np.cumsum(own, 1)[:, :-1] > 0
    return mask


#: Crossings of edges and scan lines that are sorted at once.
CROSSINGS = 1 << 20


def covered(polygons: pa.Array, canvases: pa.Array) -> np.ndarray:
    """For each row the pixels of its canvas (width, height) that its polygons cover, each once; what ``filled`` marks, without a mask.

    All rows of a batch at once: the crossings of edges and scan lines are sorted as numbers, pairs
    of them are spans, and of a row's spans on a line the union counts. A single upright rectangle
    needs no lines.
    """
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = lambda a: pc.cast(a, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    n, out = len(polygons), np.zeros(len(polygons), np.int64)
    sides, flat, canvas = size(canvases), numbers(canvases.flatten()), np.zeros((2, n))
    at = (np.cumsum(sides) - sides)[sides == 2]
    canvas[:, sides == 2] = np.maximum(np.trunc(np.nan_to_num([flat[at], flat[at + 1]], nan=0.0)), 0)

    shapes, points = polygons.flatten(), polygons.flatten().flatten()
    row, lengths, flat = np.repeat(np.arange(n), size(polygons)), size(points), numbers(points.flatten())
    at, owner = (np.cumsum(lengths) - lengths)[lengths == 2], np.repeat(np.arange(len(shapes)), size(shapes))[lengths == 2]
    x, y = flat[at], flat[at + 1]
    corners = np.bincount(owner, minlength=len(shapes))
    odd = np.bincount(owner, ~(np.isfinite(x) & np.isfinite(y)), len(shapes))
    usable = (corners > 2) & (odd == 0) & (canvas[:, row] > 0).all(0)
    x, y, row, corners = x[usable[owner]], y[usable[owner]], row[usable], corners[usable]
    if not len(row):
        return out
    # From here shapes are the usable ones; an edge leads from each point to the next of its shape.
    first, shape = np.cumsum(corners) - corners, np.repeat(np.arange(len(row)), corners)
    after = np.arange(1, len(x) + 1)
    after[first + corners - 1] = first
    width, height = canvas[:, row]
    column = lambda v, w: np.clip(np.ceil(np.fmin(v, w) - 0.5), 0, w).astype(np.int64)  # noqa: E731 first pixel whose centre is not before v
    line = column(y, height[shape])

    (a, b, c, d), alone = (first + np.minimum(k, corners - 1) for k in range(4)), np.bincount(row, minlength=n)[row] == 1
    upright = ((x[a] == x[d]) & (x[b] == x[c]) & (y[a] == y[b]) & (y[c] == y[d])) | ((x[a] == x[b]) & (x[c] == x[d]) & (y[a] == y[d]) & (y[b] == y[c]))
    upright &= alone & (corners == 4)
    a, c = a[upright], c[upright]
    out[row[upright]] = np.abs(column(x[a], width[upright]) - column(x[c], width[upright])) * np.abs(line[a] - line[c])

    low = np.where(upright[shape], 0, np.minimum(line, line[after]))
    many = np.where(upright[shape], 0, np.maximum(line, line[after]) - low)
    edge, total = np.flatnonzero(many), np.cumsum(np.bincount(row[shape], many, n).astype(np.int64))
    start, of_row = 0, np.searchsorted(row[shape[edge]], np.arange(n + 1))
    while start < n:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CROSSINGS, "right")))
        e = edge[of_row[start] : of_row[stop]]
        if len(e):
            out += _spans(e, many[e], low[e], x, y, after, shape, row, width, column, n)
        start = stop
    return out


def _spans(e, many, low, x, y, after, shape, row, width, column, n: int) -> np.ndarray:
    """Pixels by row between the crossings of edges ``e`` and the ``many`` lines from ``low`` on."""
    which = np.repeat(e, many)
    line = np.arange(len(which)) - np.repeat(np.cumsum(many) - many - low, many)
    f = after[which]
    cut = column(x[which] + (line + 0.5 - y[which]) * (x[f] - x[which]) / (y[f] - y[which]), width[shape[which]])

    def ranked(*keys):
        """Numbers from 0 of the different tuples, in their order."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), np.int64)
        new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], 0)
        rank = np.empty_like(new)
        rank[order] = np.cumsum(new)
        return rank

    # A closed shape crosses a line an even number of times, so pairs of sorted crossings never mix shapes or lines.
    step = int(width.max()) + 1
    own = ranked(shape[which], line)
    order = np.argsort(own * step + cut)
    row, line, begin, end = row[shape[which]][order][::2], line[order][::2], cut[order][::2], cut[order][1::2]
    base = ranked(row, line) * step
    order = np.argsort(base + begin)
    begin, end = (base + begin)[order], (base + end)[order]
    reached = np.maximum.accumulate(end)
    begin[1:] = np.maximum(begin[1:], reached[:-1])
    return np.bincount(row[order], np.maximum(end - begin, 0), n).astype(np.int64)


def thumbnail(image: np.ndarray, width: int = 260, height: int = 160) -> np.ndarray:
    """I8: the image within a frame, its sides in proportion, each pixel the mean of what it stands for; never enlarged."""
    h, w = image.shape[:2]
    scale = min(1.0, width / w, height / h)
    if scale == 1.0:
        return image
    rows, columns = (np.linspace(0, n, max(1, round(n * scale)) + 1).astype(int) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), rows[:-1], axis=0), columns[:-1], axis=1)
    area = np.diff(rows)[:, None] * np.diff(columns)[None, :]
    return np.rint(sums / area.reshape(area.shape + (1,) * (image.ndim - 2))).astype(np.uint8)


def thumbnails(width: int = 260, height: int = 160):
    """I8: a UDF from Spark's image struct to a thumbnail as PNG; a null image has none."""

    def run(images: pd.DataFrame) -> pd.Series:
        rows = zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True)
        return pd.Series([None if d is None else to_png(thumbnail(from_image_row(int(h), int(w), int(c), d), width, height)) for h, w, c, d in rows], dtype=object)

    return F.pandas_udf(run, "binary")


def background(kind: str, width: int, height: int, shade: int = 45) -> np.ndarray:
    """A gray ground: plain, lighter to the middle or to the edges, or with a bar below."""
    y, x = np.mgrid[:height, :width].astype(np.float64)
    if kind == "solid_gray":
        return np.full((height, width), shade, np.uint8)
    if kind == "vignette":
        far = np.hypot(x - width / 2, y - height / 2) / np.hypot(width / 2, height / 2)
        return (45 * (1 - np.minimum(far, 1)) ** 1.5).astype(np.uint8)
    if kind in ("gradient_horiz", "gradient_vert"):
        at, size = (x, width) if kind == "gradient_horiz" else (y, height)
        return (50 * np.abs(at - size / 2) / (size / 2)).astype(np.uint8)
    out = np.zeros((height, width), np.uint8)
    if kind == "toast_bottom":
        out[height - height // 3 :] = 60
    return out


def icon(name: str, width: int, height: int) -> np.ndarray:
    """Where an icon has ink, as a share of white: a disc, a triangle, or a triangle before two bars."""
    y, x = (np.mgrid[:height, :width] + 0.5) / np.array([height, width])[:, None, None]
    if name == "check":
        return np.where(np.hypot(x - 0.5, y - 0.5) <= 0.5, 0.6, 0.0)
    if name == "warning":
        return np.where(np.abs(x - 0.5) <= y / 2, 0.8, 0.0)
    bars = ((x >= 0.55) & (x < 0.7)) | (x >= 0.85)
    return np.where((x / 0.45 <= 1 - np.abs(2 * y - 1)) | bars, 1.0, 0.0)


def crop(image: np.ndarray, box: list[int]) -> np.ndarray:
    """I9."""
    x1, y1, x2, y2 = box
    return image[y1:y2, x1:x2]


def from_image_row(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The array of Spark's image source, whose bytes are BGR already."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., :3]
