"""Synthetic screen labels from a parameter grid; any range of indexes gives the same rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging
from ..sources import schema

PATTERNS = ("carousel", "message", "timer", "list_check", "toast", "title_subtitle")
BACKGROUNDS = ("solid_black", "vignette", "gradient_vert")
#: A small vocabulary of our own: words for each category and language. Others are given as a parameter.
WORDS = {
    "en": {"options": "Soft Normal Heavy Quick Eco Delicate".split(), "title": ["Wash cycle", "Water level", "Spin speed"], "message": ["Close the door", "Add detergent", "Filter is full"], "toast": ["Saved", "Connected"], "hour": ["hr", "min"]},
    "fr": {"options": "Doux Normal Fort Rapide Éco Délicat".split(), "title": ["Cycle de lavage", "Niveau d'eau", "Essorage"], "message": ["Fermez la porte", "Ajoutez du savon", "Filtre plein"], "toast": ["Enregistré", "Connecté"], "hour": ["h", "min"]},
    "el": {"options": "Απαλό Κανονικό Έντονο Γρήγορο Οικονομικό".split(), "title": ["Κύκλος πλύσης", "Στάθμη νερού"], "message": ["Κλείστε την πόρτα", "Γεμάτο φίλτρο"], "toast": ["Αποθηκεύτηκε"], "hour": ["ώρες", "λεπτά"]},
    "bg": {"options": "Меко Нормално Силно Бързо Еко".split(), "title": ["Цикъл на пране", "Ниво на водата"], "message": ["Затворете вратата", "Пълен филтър"], "toast": ["Запазено"], "hour": ["ч", "мин"]},
}


def width_of(text: str, px: int) -> int:
    """A width model that needs no font: six tenths of the height for each character."""
    return max(px // 2, round(0.6 * px * len(text)))


def words_of(words: dict, language: str) -> dict:
    """The categories of a language; one that it lacks is taken from English."""
    return WORDS["en"] | {k: v for k, v in words[language].items() if v}


def three(rng: random.Random, options: list[str]) -> list[str]:
    """Three options: different ones as far as there are, then any of them again."""
    chosen = rng.sample(options, min(3, len(options)))
    return chosen + [rng.choice(options) for _ in range(3 - len(chosen))]


def label(index: int, pattern: str, language: str, seed: int, canvas: tuple[int, int] = (320, 240), vocabulary: dict = WORDS) -> dict:
    """The label of one index, drawn from ``seed`` + index alone."""
    rng, words, (w, h) = random.Random(seed + index), words_of(vocabulary, language), canvas
    elements, raw = [], []

    def put(text: str, y: int, px: int, selected: bool | None = None, color: str = "white", x: int | None = None, truncated: bool | None = None) -> None:
        wide = width_of(text, px)
        left = (w - wide) // 2 if x is None else x
        size = "small" if px < 18 else "medium" if px < 32 else "large" if px < 60 else "xl"
        elements.append({"type": "text", "bbox": [left, y, left + wide, y + px], "text": text, "selected": selected, "truncated": truncated, "color_class": color, "size_class": size})
        raw.append(text)

    def icon(name: str, x: int, y: int, px: int = 16) -> None:
        elements.append({"type": "icon", "bbox": [x, y, x + px, y + px], "icon_name": name})
        raw.append(f"[{name.upper()}]")

    if pattern == "carousel":
        put(rng.choice(words["title"]), 15, 16, False)
        for k, t in enumerate(three(rng, words["options"])):
            put(t, 72 + 45 * k, 28 if k == 1 else 20, k == 1, "white" if k == 1 else "gray")
    elif pattern == "message":
        if rng.random() < 0.35:
            icon("warning", w // 2 - 12, 20, 24)
        put(rng.choice(words["message"]), 80, 22, True)
        put(rng.choice(words["message"]), 120, 18, False, "gray")
    elif pattern == "timer":
        put(rng.choice(words["title"]), 14, 17, False)
        if language == "en" and rng.random() < 0.4:  # a time of day, its prefix in two lines beside it
            clock = f"{rng.randint(1, 12)}:{rng.choice(('00', '15', '30', '45'))}"
            put("Today", 64, 22, x=20)
            put("AM", 88, 22, x=20)
            put(clock, 64, 64, x=110)
            raw[-3:] = [f"Today AM {clock}"]
        else:
            hours, minutes = rng.randint(0, 4), rng.choice((0, 15, 30, 45))
            minutes = minutes if hours else rng.choice((15, 30, 45, 60, 90))
            parts = [(str(hours), 64), (words["hour"][0], 22)] * (hours > 0) + [(str(minutes), 64), (words["hour"][1], 22)]
            x = (w - sum(width_of(t, px) + 6 for t, px in parts)) // 2
            for t, px in parts:  # on one base line
                put(t, 64 + 64 - px, px, x=x)
                x += width_of(t, px) + 6
            raw[-len(parts) :] = [" ".join(t for t, _ in parts)]
        put(rng.choice(words["options"]), 168, 17, False)
        if language == "en" and rng.random() < 0.7:
            put("Press", 206, 14, x=40)
            icon("play_pause", 92, 206, 14)
            put("to add garments.", 206, 14, x=122)
            raw[-3:] = ["Press [PLAY_PAUSE] to add garments."]
    elif pattern == "list_check":
        put(rng.choice(words["title"]), 15, 16, False)
        for k, t in enumerate(three(rng, words["options"])):
            icon("check", 20, 70 + 45 * k)
            put(t, 68 + 45 * k, 22, k == 0, x=50)
    elif pattern == "toast":
        put(rng.choice(words["toast"]), h - 40, 20, True)
    else:
        put(rng.choice(words["title"]), 16, 20, False, truncated=rng.random() < 0.1)
        put(rng.choice(words["message"]), 100, 22, True)
    background = "toast_bottom" if pattern == "toast" else rng.choice(BACKGROUNDS)
    return {"image_path": f"images/screen_{index:04d}_{pattern}_{language}.png", "pattern": pattern, "language": language, "background": background, "canvas_size": list(canvas), "elements": elements, "raw_text": "\n".join(raw)}


def screens(spark: SparkSession, count: int, start: int = 0, seed: int = 42, languages: list[str] | None = None, patterns: list[str] | None = None, canvas: tuple[int, int] = (320, 240), vocabulary: dict = WORDS) -> DataFrame:
    """Labels of the indexes from ``start``; languages and patterns share them evenly.

    ``vocabulary`` has the words of each language by category: options, title, message, toast, hour.
    """
    order = schedule(seed, languages, patterns, vocabulary)
    if count < 0 or start < 0:
        raise ValueError("count and start must not be negative")
    at = (F.col("id") % len(order)).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(o[k]) for o in order]), at)
    return planned(spark.range(start, start + count).select(F.col("id").alias("index"), pick(0).alias("pattern"), pick(1).alias("language")), seed, canvas, vocabulary)


def schedule(seed: int, languages: list[str] | None = None, patterns: list[str] | None = None, vocabulary: dict = WORDS) -> list[tuple[str, str]]:
    """All (pattern, language) in a seeded order, which indexes go through again and again, so none gets over one row more than another."""
    languages, patterns = list(dict.fromkeys(vocabulary if languages is None else languages)), list(PATTERNS if patterns is None else patterns)
    if unknown := [x for x in languages if x not in vocabulary] + [x for x in patterns if x not in PATTERNS]:
        raise ValueError(f"unknown: {unknown}")
    if not languages or not patterns:
        raise ValueError("at least one language and one pattern")
    order = [(p, l) for l in languages for p in patterns]
    random.Random(seed).shuffle(order)
    return order


def planned(plan: DataFrame, seed: int = 42, canvas: tuple[int, int] = (320, 240), vocabulary: dict = WORDS) -> DataFrame:
    """The label of each row of ``plan`` (index, pattern, language), drawn from seed and index alone: any partitioning gives the same rows.

    Rows of an unknown pattern or language, or with a null, are an error when they are reached.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for i, pattern, language in pdf.itertuples(index=False):
                if pattern not in PATTERNS or language not in vocabulary or i is None:
                    raise ValueError(f"unknown: {i}, {pattern}, {language}")
                rows.append(label(int(i), pattern, language, seed, canvas, vocabulary))
            yield pd.DataFrame(rows, columns=["image_path", "pattern", "language", "background", "canvas_size", "elements", "raw_text"])

    return plan.select("index", "pattern", "language").mapInPandas(run, schema.LABELS).withColumn("elements", F.transform("elements", lambda e: e))


def drawn(row) -> bytes:
    """A label's screen as PNG. There are no fonts: a text is a row of bars, one for each character, in its box and colour."""
    w, h = (int(v) for v in row["canvas_size"])
    page = imaging.background(row["background"], w, h).astype(np.float64)
    for e in row["elements"]:
        x1, y1, x2, y2 = (int(v) for v in e["bbox"])
        clip = (slice(max(0, y1), min(h, y2)), slice(max(0, x1), min(w, x2)))
        if clip[0].start >= clip[0].stop or clip[1].start >= clip[1].stop:
            continue
        if e["type"] == "icon":
            ink = imaging.icon(e["icon_name"], x2 - x1, y2 - y1)
        else:
            bars = np.frombuffer("".join("0" if c.isspace() else "1" for c in e["text"]).encode(), np.uint8) - 48
            ink = np.tile(bars[np.arange(x2 - x1) * len(bars) // (x2 - x1)] * (np.arange(x2 - x1) % 3 > 0), (y2 - y1, 1)) * (0.6 if e["color_class"] == "gray" else 1.0)
        part = ink[clip[0].start - y1 : clip[0].stop - y1, clip[1].start - x1 : clip[1].stop - x1]
        page[clip] = page[clip] * (1 - part) + 255 * part
    return imaging.to_png(np.rint(page).astype(np.uint8))


def pictures(labels: DataFrame) -> DataFrame:
    """(name, content) of the screens of ``labels``, for ``sinks.image_files``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["image_path"], "content": [drawn(r) for r in pdf.to_dict("records")]})

    return labels.select("image_path", "background", "canvas_size", "elements").mapInPandas(run, "name string, content binary")
