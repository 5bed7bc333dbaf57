"""The three entry points as plans: compare archives, score a recogniser, build data sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, imaging, repair, text
from ..functions.text import bind
from ..operators import metrics, rank, relate
from ..sources import schema


class Recognizer(Protocol):
    """Recognises the text boxes of one image, (corners, text, score) each."""

    def __call__(self, image: np.ndarray, **settings) -> list[tuple]: ...


#: Settings of the second readings of lists, delays and garbled timers.
COMPACT = {"unclip": 3.5, "side": 320, "thresh": 0.3, "dilate": True}
OPTIONS = ({"unclip": 3.5, "side": 800, "thresh": 0.4, "dilate": False}, {"unclip": 2.5, "side": 960, "thresh": 0.35, "dilate": False})


def boxes_of(make: Callable[[], Recognizer], **settings):
    """A UDF from Spark's image struct to boxes; the model is made once in each worker, and a null image, which is not read, has null boxes.

    It counts as non-deterministic, so Spark neither copies it into the expressions on its
    result nor runs a model twice for one row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = make()
        for pdf in batches:
            out = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                found = None if data is None else model(imaging.from_image_row(int(h), int(w), int(c), data), **settings)
                out.append(found if found is None else [{"bbox": b, "text": t, "score": float(s)} for b, t, s in found])
            yield pd.Series(out)

    return F.pandas_udf(run, schema.BOXES).asNondeterministic()


IMAGE = ("height", "width", "nChannels", "data")


def recognise(images: DataFrame, make: Callable[[], Recognizer], custom: bool = False) -> DataFrame:
    """Text, box count and mean score of each image; with a custom detector also the second readings.

    A condition around a Python UDF does not skip it, so a row that needs no second reading
    sends a null image, for which the UDF does nothing: the plan is one line of steps without
    branches, and images travel only where they are read again.
    """
    rows = images.withColumn("boxes", boxes_of(make)(F.struct(*IMAGE)))
    if custom:
        rows = rows.withColumn("boxes", geometry.select_result(F.col("boxes"), boxes_of(make, unclip=3.0)(F.struct(*IMAGE))))
    rows = rows.withColumn("n_boxes", F.size("boxes")).withColumn("read", geometry.boxes_to_text(F.col("boxes"))).select("*", "read.text", "read.mean_score").drop("read", "boxes")
    if custom:
        rows = again(rows, lambda t: repair.broken_timer_at(repair.full_lines(t)) > 0, make, COMPACT, repair.repair_timer)
        for settings in OPTIONS:
            better = lambda t, c: bind(repair.known_tokens(c), lambda k: F.when(repair.recovers_option_tail(t, k), k).otherwise(t))
            rows = again(rows, repair.misses_option_tail, make, settings, better)
        delayed = lambda t: F.regexp_replace(t, repair.DELAY_WORDS, "El Inicio").rlike(repair.DELAY_ON)
        rows = again(rows, delayed, make, COMPACT, repair.merge_delay)
    return repair.repaired(rows, "text", "text")


def again(rows: DataFrame, need, make, settings: dict, merge) -> DataFrame:
    """``rows``, with the text of those that ``need`` it merged with a second reading; the text is used once, so the plan grows by a step."""
    image = F.when(F.coalesce(bind(F.col("text"), need), F.lit(False)), F.struct(*IMAGE))
    rows = rows.withColumn("_again", boxes_of(make, **settings)(image))
    rows = rows.withColumn("_second", geometry.boxes_to_text(F.col("_again"))["text"]).drop("_again")
    both = F.struct(F.col("text").alias("a"), F.col("_second").alias("b"))
    return rows.withColumn("text", bind(both, lambda t: F.when(t["b"].isNotNull(), merge(t["a"], t["b"])).otherwise(t["a"]))).drop("_second")


def scored(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", unicode: bool = True) -> DataFrame:
    """Rates and verdict of each row; texts are normalised once. ``unicode=False`` is for text known to be NFC."""
    form = text.normalize_nfc if unicode else lambda c: text.collapse(F.coalesce(c, F.lit("")))
    rows = rows.withColumn("_r", form(F.col(ref))).withColumn("_h", form(F.col(hyp)))
    rows = rows.withColumn("cer", text.cer(F.col("_r"), F.col("_h"))).withColumn("wer", text.wer(F.col("_r"), F.col("_h")))
    return rows.withColumn("verdict", text.verdict(F.col("cer"))).drop("_r", "_h")


def app_scored(rows: DataFrame, ref: str = "reference", hyp: str = "prediction") -> DataFrame:
    """The application's rate, on compatibility forms."""
    rate = text.cer_floor(text.normalize_nfkc(F.col(ref)), text.normalize_nfkc(F.col(hyp)))
    return rows.withColumn("cer", rate).withColumn("verdict", text.verdict(F.col("cer")))


def compare(test: DataFrame, reference: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Entry A: (report rows, all pairs) of two archives' entries; the reference's reading is the truth."""
    both = relate.pair(relate.last_wins(test, "stem", "ordinal"), relate.last_wins(reference, "stem", "ordinal"), "stem")
    matched = both.where("pair_class = 'matched'")
    sides = [read(matched.select("stem", F.col(f"{s}.display_name").alias("filename"), F.col(f"{s}.content").alias("content"))).select("stem", "filename", F.col("text").alias(f"{k}_text")) for s, k in (("test", "test"), ("reference", "ref"))]
    rows = sides[0].join(sides[1].drop("filename"), "stem")
    return rank.numbered(scored(rows, "ref_text", "test_text"), "filename", "stem"), both


def report(rows: DataFrame) -> dict[str, DataFrame]:
    """Entry B: the tables of a report from scored rows."""
    rows = rows.withColumn("script", text.script_of(F.col("language")))
    return {
        "overall": metrics.overall(rows, "cer", "wer"),
        "groups": metrics.groupings(rows, ["script", "language", "background", "pattern"]),
        "verdicts": metrics.verdict_counts(rows),
        "quantiles": metrics.nearest_ranks(rows, "cer"),
        "worst": rank.top(rows, 20, F.desc("cer"), "image_path"),
        "medians": rank.upper_median(rows, "script", "cer", "image_path"),
    }
