"""Boxes, polygons and reading order as array expressions; one row is one screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

#: Vertical reach of a line, and limits of the icons in the left gutter and the status bar.
LINE_REACH = 12.0
GUTTER = {"right": 45, "width": 35, "height": 24}
STATUS = {"top": 35, "bottom": 65, "width": 70, "height": 55}
GUTTER_TEXT = r"(?iuU)^[\-\sbcilmopu0-9]+$"


def bounds(polygon: Column) -> Column:
    """struct<x1, y1, x2, y2> of corner points array<array<double>>."""
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def has_word(text: Column) -> Column:
    """At least three letters of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3


def boxed(boxes: Column) -> Column:
    """Recognised boxes (bbox, text, score) with bounds and the midpoint of these."""
    def one(b):
        e = bounds(b["bbox"])
        return F.struct(((e["y1"] + e["y2"]) / 2).alias("y"), ((e["x1"] + e["x2"]) / 2).alias("x"), e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), b["text"].alias("text"), b["score"].alias("score"))

    return F.transform(boxes, one)


def corner_mean(boxes: Column) -> Column:
    """Recognised boxes with the mean of their four corners."""
    mean = lambda b, k: F.aggregate(b["bbox"], F.lit(0.0), lambda a, p: a + F.get(p, F.lit(k))) / F.size(b["bbox"])
    return F.transform(boxes, lambda b: F.struct(mean(b, 1).alias("y"), mean(b, 0).alias("x"), b["text"].alias("text"), b["score"].alias("score")))


def drop_gutter_icons(items: Column) -> Column:
    """Without small marks left of a text and status icons above one; another box is another index, not another value."""
    return bind(items, _drop_gutter_icons)


def _drop_gutter_icons(items: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(items) - 1)

    def others(i: Column, test) -> Column:
        return F.exists(F.when(F.size(items) > 0, at).otherwise(F.array().cast("array<int>")), lambda j: (j != i) & test(F.get(items, j)))

    def stays(b: Column, i: Column) -> Column:
        w, h, t = b["x2"] - b["x1"], b["y2"] - b["y1"], strip(b["text"])
        small = (b["x2"] <= GUTTER["right"]) & (w <= GUTTER["width"]) & (h <= GUTTER["height"]) & t.rlike(GUTTER_TEXT)
        beside = others(i, lambda o: (F.abs(b["y"] - o["y"]) <= LINE_REACH) & (o["x1"] >= b["x1"]) & (o["x2"] > GUTTER["right"]) & has_word(o["text"]))
        high = (b["y1"] <= STATUS["top"]) & (b["y2"] <= STATUS["bottom"]) & (w <= STATUS["width"]) & (h <= STATUS["height"]) & F.lower(t).isin("p", "up")
        below = others(i, lambda o: (o["y1"] > b["y2"]) & has_word(o["text"]))
        return ~((small & beside) | (high & below))

    return F.filter(items, stays)


def lines(items: Column, text_ties: bool = False, reach: float = LINE_REACH) -> Column:
    """array<array<struct<x, text>>>: items (y, x, text) gathered to lines from the top.

    An item joins the line while it is within ``reach`` of the running anchor, which moves
    half way to each item that joins. The order decides, so this is a fold, not a grouping.
    Ties in (y, x) go by text or else by input order. The arrays of one screen are short.
    """
    tie = (lambda b, i: b["text"]) if text_ties else (lambda b, i: i)
    keyed = F.transform(items, lambda b, i: F.struct(b["y"].cast("double").alias("y"), b["x"].cast("double").alias("x"), tie(b, i).alias("tie"), b["text"].alias("text")))
    item = lambda b: F.struct(b["x"].alias("x"), b["text"].alias("text"))
    empty = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<array<struct<x:double,text:string>>>").alias("done"))

    def step(acc, b):
        joins = F.coalesce(F.abs(b["y"] - acc["y"]) <= reach, F.lit(False))
        last = F.try_element_at(acc["done"], F.lit(-1))
        longer = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.concat(last, F.array(item(b)))))
        return F.struct(F.when(joins, (acc["y"] + b["y"]) / 2).otherwise(b["y"]).alias("y"), F.when(joins, longer).otherwise(F.concat(acc["done"], F.array(F.array(item(b))))).alias("done"))

    return F.aggregate(F.array_sort(keyed), empty, step, lambda acc: acc["done"])


def text_of(found: Column) -> Column:
    """Lines of items as text: items by (x, text) with a space between, a line end after each line."""
    return F.array_join(F.transform(found, lambda l: F.array_join(F.transform(F.array_sort(l), lambda b: b["text"]), " ")), "\n")


def mean_score(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, b: a + b["score"]) / F.size(items)).otherwise(0.0)


def select_result(primary: Column, fallback: Column) -> Column:
    """The fallback's boxes where the primary has none, or where it has more of them at no lower mean score."""
    better = (F.size(fallback) > F.size(primary)) & (mean_score(fallback) >= mean_score(primary))
    return F.when((F.size(primary) == 0) | better, fallback).otherwise(primary)


def boxes_to_text(boxes: Column) -> Column:
    """struct<text, mean_score>, icons dropped, midpoints as centres."""
    read = lambda kept: F.struct(text_of(lines(kept)).alias("text"), mean_score(kept).alias("mean_score"))
    return bind(drop_gutter_icons(boxed(boxes)), read)


def corners_to_text(boxes: Column) -> Column:
    """The other engine's rule: every box, corner means, ties by text."""
    return text_of(lines(corner_mean(boxes), text_ties=True))


def truth_of(elements: Column) -> Column:
    """Text of a label's text elements from their places."""
    texts = F.filter(elements, lambda e: (e["type"] == "text") & (F.coalesce(e["text"], F.lit("")) != "") & (F.size(e["bbox"]) == 4))
    xy = lambda e, a, b: (F.get(e["bbox"], F.lit(a)) + F.get(e["bbox"], F.lit(b))) / 2.0
    return text_of(lines(F.transform(texts, lambda e: F.struct(xy(e, 1, 3).alias("y"), xy(e, 0, 2).alias("x"), e["text"].alias("text")))))


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(v, high if isinstance(high, Column) else F.lit(high)))


def crop_box(bbox: Column, width: Column, height: Column, margin: int = 4, least: int = 8) -> Column:
    """The padded box within the image, null where a side is under ``least``."""
    at = lambda k: F.get(bbox, F.lit(k))
    b = F.array(F.greatest(F.lit(0), at(0) - margin), F.greatest(F.lit(0), at(1) - margin), F.least(width, at(2) + margin), F.least(height, at(3) + margin))
    ok = (F.size(bbox) == 4) & (F.get(b, F.lit(2)) - F.get(b, F.lit(0)) >= least) & (F.get(b, F.lit(3)) - F.get(b, F.lit(1)) >= least)
    return F.when(ok, b)


def polygon_box(bbox: Column, width: Column, height: Column, area: int = 16, side: int = 3) -> Column:
    """The box clipped to the canvas, null where it is too small to learn from."""
    at = lambda k: F.get(bbox, F.lit(k))
    b = F.array(clamp(at(0), 0, width), clamp(at(1), 0, height), clamp(at(2), 0, width), clamp(at(3), 0, height))
    w, h = F.get(b, F.lit(2)) - F.get(b, F.lit(0)), F.get(b, F.lit(3)) - F.get(b, F.lit(1))
    return F.when((F.size(bbox) == 4) & (w > 0) & (h > 0) & (w * h >= area) & (F.least(w, h) >= side), b)


def corners(box: Column) -> Column:
    """Clockwise corner points from the top left."""
    at = lambda k: F.get(box, F.lit(k))
    return F.when(box.isNotNull(), F.array(F.array(at(0), at(1)), F.array(at(2), at(1)), F.array(at(2), at(3)), F.array(at(0), at(3))))
