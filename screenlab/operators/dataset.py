"""Manifests, splits, characters and training lists."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geometry, imaging
from ..functions.text import crop_name, strip, unicode_form
from .rank import numbered
from .relate import first_wins


def text_elements(elements: Column) -> Column:
    """P5."""
    return F.filter(elements, lambda e: e["type"] == "text")


def texts_of(elements: Column) -> Column:
    """Non-empty texts of the text elements, in order."""
    return F.transform(F.filter(elements, lambda e: (e["type"] == "text") & (F.coalesce(e["text"], F.lit("")) != "")), lambda e: e["text"])


def texts_or_raw(elements: Column, raw: Column) -> Column:
    """P18."""
    texts = texts_of(elements)
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.coalesce(raw, F.lit(""))))


def start_key(texts: Column) -> Column:
    """P14."""
    return F.exists(texts, lambda t: t.contains("▶") | t.contains("Ⅱ") | t.contains("II"))


def manifest(sources: list[DataFrame], path: str = "image_path") -> DataFrame:
    """The sources in order, first row of each path; each needs a column ``line_ord``."""
    rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(k))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    return first_wins(rows, path, "src_ord", "line_ord")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """A14."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct")).withColumn("n_duplicates", F.col("n") - F.col("n_distinct"))


def bad_chars(text: Column, known: Column) -> Column:
    """Different characters outside ``known``, in code-point order."""
    return F.array_sort(F.array_except(F.filter(F.split(text, ""), lambda c: c != ""), known))


def in_dictionary(text: Column, known: Column) -> Column:
    """Only known characters and spaces."""
    return F.size(F.array_except(F.filter(F.split(text, ""), lambda c: (c != "") & (c != " ")), known)) == 0


def dictionary_column(chars: DataFrame, most: int = 100_000) -> Column:
    """The character set as a literal array; code points bound its size, which is checked."""
    known = [r[0] for r in chars.select("ch").distinct().orderBy("ch").limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"a dictionary of over {most} characters")
    return F.array(*[F.lit(c) for c in known]) if known else F.array().cast("array<string>")


#: Characters counted at a time.
COUNT_CHARS = 1 << 20


def char_counts(rows: DataFrame, text: str, *keys: str, order: str | None = None) -> DataFrame:
    """(keys, ch, n) over whole texts, control characters left out; null and empty texts have none.

    Each batch counts its code points, COUNT_CHARS at a time, so the shuffle carries a row for each
    character and key of a task, whatever the length of the texts. With ``order``, a column
    that numbers the rows, ``first`` tells where a character comes first: row, then place.
    """
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ch string, n long", *(["row long, place long"] if order else [])])

    def code_points(texts):
        """Pieces of the texts, at most COUNT_CHARS characters long, several short texts together."""
        held, size = [], 0
        for t in texts:
            for k in range(0, len(t), COUNT_CHARS):
                held.append(t[k : k + COUNT_CHARS])
                size += len(held[-1])
                if size >= COUNT_CHARS:
                    yield np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
                    held, size = [], 0
        if held:
            yield np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)

    def counted(ts):
        total = np.zeros(0, np.int64)
        for cps in code_points(t for _, t in ts):
            n = np.bincount(cps, minlength=len(total))
            n[: len(total)] += total
            total = n
        return [(chr(c), int(total[c])) for c in np.flatnonzero(total).tolist() if c >= 32]

    def placed(ts):
        found = {}
        for o, t in sorted(ts, key=lambda x: x[0]):
            start = 0
            for cps in code_points([t]):
                for c, at, n in zip(*(x.tolist() for x in np.unique(cps, return_index=True, return_counts=True)), strict=True):
                    if c >= 32:
                        m, *first = found.get(c, (0, o, start + at))
                        found[c] = (m + n, *first)
                start += len(cps)
        return [(chr(c), *x) for c, x in found.items()]

    def run(batches):
        for batch in batches:
            groups: dict = {}
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            orders = batch.column("_order").to_pylist() if order else [0] * batch.num_rows
            for t, k, o in zip(batch.column(text).to_pylist(), names, orders, strict=True):
                if t:
                    groups.setdefault(k, []).append((o, t))
            out = [(*k, *row) for k, ts in groups.items() for row in (placed(ts) if order else counted(ts))]
            types = [*(batch.schema.field(k).type for k in keys), pa.string(), *[pa.int64()] * (3 if order else 1)]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keys, "ch", "n", *(["row", "place"] if order else [])])

    some = rows.select(*keys, text, *([F.col(order).cast("long").alias("_order")] if order else []))
    first = [F.min(F.struct("row", "place")).alias("first")] if order else []
    return some.mapInArrow(run, schema).groupBy(*keys, "ch").agg(F.sum("n").alias("n"), *first)


def top_chars(counts: DataFrame, k: int = 50) -> DataFrame:
    """T4; ties by first appearance where ``counts`` tell it, else by code point."""
    return counts.orderBy(F.desc("n"), "first" if "first" in counts.columns else "ch", "ch").limit(k)


def order_key(seed: int, key: str) -> Column:
    """A seeded order that any partitioning gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def exact_permutation(n: int, seed: int) -> list[int]:
    """The permutation that Python's seeded shuffle gives; for sets small enough to list."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def split(rows: DataFrame, key: str, sizes: list[tuple[str, int | None]], seed: int) -> DataFrame:
    """Contiguous parts of a seeded order, as column ``split``; a size of None takes the rest.

    Rows past the last fixed size are left out if no part takes the rest. Negative sizes and
    sizes after the one that takes the rest are errors.
    """
    if any(n is not None and n < 0 for _, n in sizes) or any(n is None for _, n in sizes[:-1]):
        raise ValueError(f"sizes: {sizes}")
    placed = numbered(rows.withColumn("_o", order_key(seed, key)), "_o", key).drop("_o")
    out = F.lit(None).cast("string")
    for name, n in reversed(list(_bounds(sizes))):
        low, high = n
        ok = (F.col("row") > low) & (F.col("row") <= high if high is not None else F.lit(True))
        out = F.when(ok, name).otherwise(out)
    return placed.withColumn("split", out).where("split is not null").drop("row")


def _bounds(sizes):
    at = 0
    for name, n in sizes:
        yield name, (at, None if n is None else at + n)
        at += n or 0


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """U5."""
    return a.join(b.select(key), key, "left_semi").isEmpty()


def balanced(rows: DataFrame, key: str, items: list[str], seed: int) -> DataFrame:
    """U8: an item for each row, counts at most one apart: the place in a seeded order, modulo the items."""
    order = list(dict.fromkeys(items))
    if not order:
        raise ValueError("no item to give")
    random.Random(seed).shuffle(order)
    placed = numbered(rows.withColumn("_o", order_key(seed, key)), "_o", key).drop("_o")
    names = F.array(*[F.lit(x) for x in order])
    return placed.withColumn("item", F.get(names, F.pmod(F.col("row") - 1, F.lit(len(order))).cast("int"))).drop("row")


def crop_candidates(labels: DataFrame, known: Column, folder: str = "crops") -> DataFrame:
    """(image_path, crop_path, text, box, fate) of every text element; fate: crop, oov, size or empty.

    Crops are numbered by the element's place among all elements, icons too; texts are NFC without white
    space at their ends.
    """
    e = labels.select("image_path", F.get("canvas_size", F.lit(0)).alias("w"), F.get("canvas_size", F.lit(1)).alias("h"), F.posexplode("elements").alias("i", "e")).where("e.type = 'text'")
    box = geometry.crop_box(F.col("e.bbox"), F.col("w"), F.col("h"))
    rows = e.withColumn("text", strip(unicode_form("NFC")(F.coalesce("e.text", F.lit(""))))).withColumn("box", box)
    fate = F.when(F.col("text") == "", "empty").when(F.col("box").isNull(), "size").when(in_dictionary(F.col("text"), known), "crop").otherwise("oov")
    return rows.select("image_path", crop_name(F.lit(folder), F.col("image_path"), F.col("i")).alias("crop_path"), "text", "box", fate.alias("fate"))


def recognition_list(labels: DataFrame, known: Column, folder: str = "crops") -> DataFrame:
    """K5: (crop_path, text, box, known) of every text element that has a text and is large enough."""
    rows = crop_candidates(labels, known, folder).where("fate in ('crop', 'oov')")
    return rows.select("crop_path", "text", "box", (F.col("fate") == "crop").alias("known"))


def crops(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """(crop_path, text, png) of the candidates that become crops, cut from ``images`` (image_path, height, width, nChannels, data).

    A candidate whose image is missing is left out, as are boxes beyond the image. Images
    travel once to the tasks that cut them: the boxes of an image are gathered first.
    """
    boxes = candidates.where("fate = 'crop'").groupBy("image_path").agg(F.collect_list(F.struct("crop_path", "text", "box")).alias("boxes"))

    def run(batches):
        for pdf in batches:
            out = []
            for h, w, c, data, boxes in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], pdf["boxes"], strict=True):
                image = imaging.from_image_row(h, w, c, data)
                for b in boxes:
                    cut = imaging.crop(image, list(b["box"]))
                    if cut.size:
                        out.append((b["crop_path"], b["text"], imaging.to_png(cut)))
            yield pd.DataFrame(out, columns=["crop_path", "text", "png"])

    return images.join(boxes, "image_path").mapInPandas(run, "crop_path string, text string, png binary")


def watched(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and counters that are there once an action has run on them: all rows, and those of each condition."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen


def row_counters(rows: DataFrame) -> DataFrame:
    """(counter, key, n) over language rows: patterns, unknown characters (once a row), rows with a start key."""
    pair = lambda name, value: F.struct(F.lit(name).alias("counter"), value.alias("key"))
    marks = F.concat(F.array(pair("pattern", F.col("pattern"))), F.transform("bad", lambda c: pair("unknown", c)), F.when(F.col("start_key"), F.array(pair("start_key", F.lit("")))).otherwise(F.array().cast("array<struct<counter:string,key:string>>")))
    return rows.select(F.explode(marks).alias("m")).groupBy("m.counter", "m.key").agg(F.count("*").alias("n"))


def detection_list(labels: DataFrame) -> DataFrame:
    """(image_path, polygons JSON); images without any polygon are left out."""
    w, h = F.get("canvas_size", F.lit(0)), F.get("canvas_size", F.lit(1))
    polys = F.transform(F.filter(text_elements(F.col("elements")), lambda e: geometry.polygon_box(e["bbox"], w, h).isNotNull()), lambda e: F.struct(F.coalesce(e["text"], F.lit("")).alias("transcription"), geometry.corners(geometry.polygon_box(e["bbox"], w, h)).alias("points")))
    return labels.withColumn("_p", polys).where(F.size("_p") > 0).select("image_path", F.to_json("_p").alias("polygons"))


def language_rows(labels: DataFrame, language: str, known: Column, prefix: str = "") -> DataFrame:
    """Rows of a language with texts, raw text rebuilt, and the unknown characters."""
    rows = labels.where(F.col("language") == language).withColumn("texts", texts_of(F.col("elements"))).where(F.size("texts") > 0)
    rows = rows.withColumn("raw_text", F.array_join("texts", "\n")).withColumn("bad", bad_chars(F.col("raw_text"), F.array_union(known, F.array(F.lit(" "), F.lit("\n")))))
    path = F.concat_ws("/", F.lit(prefix), "image_path") if prefix else F.col("image_path")
    return rows.withColumn("image_path", path).withColumn("start_key", start_key(F.col("texts")))


def polygon_coverage(rows: DataFrame, polygons: str = "polygons", canvas: str = "canvas_size") -> DataFrame:
    """``rows`` with ``n_positive``, the pixels of the canvas (width, height) that their polygons cover, each once.

    Null or empty polygons and canvases cover nothing; polygons of under three points neither.
    """

    @F.arrow_udf("long")
    def covered(shapes: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array(imaging.covered(shapes, sizes))

    return rows.withColumn("n_positive", covered(polygons, canvas))


def coverage_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Samples, those with any covered pixel, covered pixels and their mean over all samples; 0 on no rows."""
    grouped = rows.groupBy(*keys) if keys else rows
    pixels = F.coalesce(F.sum("n_positive"), F.lit(0))
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("n_positive") > 0).alias("n_positive"), pixels.alias("pixels"), (pixels / F.greatest(F.count("*"), F.lit(1))).alias("mean_pixels"))


def sampled(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of a seeded order; any partitioning gives the same ones."""
    return rows.orderBy(order_key(seed, key), key).limit(n)
