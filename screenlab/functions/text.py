"""Normalisation, error rates, verdicts and names; everything but Unicode forms stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the input rules (Java's \s under (?U) lacks four of these), and marks that are deleted.
SPACE = r"(?U)[\s\x1c-\x1f]+"
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
MARKS = "‏‎"
#: A press verb, a garbled play/pause sign and a preposition, and the sign itself.
PRESS_KEY = r"(?iuU)\b(Press|Presione|Appuyez)\s+(?:▶\s*(?:[fIl1|Ⅱ]{1,2}|A\s*(?:Ⅱ|II)?\s*[lI1|]?)|A\s*[lI1|]|™\s*[lI1|]|[fIl1|Ⅱ]{1,2})\s+(?=(?:to|para|pour|or)\b)"
START_SIGN = r"(?U)\s*▶\s*(?:Ⅱ|II)\s*"
#: Language tags by script.
SCRIPTS = {
    "latin": "en fr de it es pt nl no pl cs lt lv vi",
    "cyrillic": "ru uk bg",
    "arabic": "ar ar_eg",
    "greek": "el",
    "thai": "th",
    "chinese_simplified": "zh_cn",
    "chinese_traditional": "zh_tw",
}
#: Inclusive upper bounds of the verdicts.
PASS_MOST, WARN_MOST = 0.05, 0.20
#: First code points that stand for tokens in a token distance: private use, then the supplementary plane.
TOKEN_BASE, TOKEN_BASE_MANY = 0xE000, 0xF0000


def unicode_form(form: str):
    """A pandas UDF to a Unicode normal form; most text is in it already and passes as it is."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t), na_action="ignore")

    return F.pandas_udf(run, "string")


def casefold():
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    return F.pandas_udf(run, "string")


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, STRIP, "")


def normalize_nfc(text: Column) -> Column:
    """Null as empty, NFC, direction marks deleted, white space collapsed."""
    return collapse(F.translate(unicode_form("NFC")(F.coalesce(text, F.lit(""))), MARKS, ""))


def normalize_nfkc(text: Column) -> Column:
    """Null as empty, NFKC, start signs in one form, white space collapsed; direction marks stay."""
    t = unicode_form("NFKC")(F.coalesce(text, F.lit("")))
    return collapse(F.regexp_replace(F.regexp_replace(t, PRESS_KEY, "$1 ▶II "), START_SIGN, " ▶II "))


def error_rate(distance: Column, length: Column, empty_hyp: Column) -> Column:
    return F.when(length == 0, F.when(empty_hyp, 0.0).otherwise(1.0)).otherwise(distance / length)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of texts already normalised; an empty reference gives 0 or 1. Can exceed 1."""
    return error_rate(F.levenshtein(ref, hyp), F.length(ref), F.length(hyp) == 0)


def cer_floor(ref: Column, hyp: Column) -> Column:
    """The variant that divides by at least 1: an empty reference gives the length of the hypothesis."""
    return F.levenshtein(ref, hyp) / F.greatest(F.lit(1), F.length(ref))


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of token arrays: each different token becomes one character.

    A private-use block holds 6,400 different tokens of a pair; pairs with more use a plane of 65,000.
    """

    def distance(names: Column) -> Column:
        base = F.when(F.size(names) <= 6400, TOKEN_BASE - 1).otherwise(TOKEN_BASE_MANY - 1)
        drawn = lambda ts: F.array_join(F.transform(ts, lambda t: F.format_string("%c", (base + F.array_position(names, t)).cast("int"))), "")
        return F.levenshtein(drawn(a), drawn(b))

    return bind(F.array_distinct(F.concat(a, b)), distance)


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of normalised texts; an empty text is one empty token."""
    a, b = F.split(ref, " ", -1), F.split(hyp, " ", -1)
    return error_rate(token_distance(a, b), F.when(ref == "", 0).otherwise(F.size(a)), hyp == "")


def verdict(rate: Column) -> Column:
    return F.when(rate <= PASS_MOST, "PASS").when(rate <= WARN_MOST, "WARN").otherwise("FAIL")


def severity(rate: Column) -> Column:
    """Chart colours; unlike the verdict's, these bounds are exclusive."""
    return F.when(rate < 0.20, "green").when(rate < 0.50, "orange").otherwise("red")


def size_class(px: Column) -> Column:
    return F.when(px < 18, "small").when(px < 32, "medium").when(px < 60, "large").otherwise("xl")


def script_of(lang: Column) -> Column:
    pairs = [F.lit(x) for script, tags in SCRIPTS.items() for tag in tags.split() for x in (tag, script)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), F.lit("other"))


def leaf(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def stem(path: Column) -> Column:
    """Leaf name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(leaf(path), r"(?s)(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(leaf(path), r"(?s).(\.[^.]*)$", 1)


def filename_parts(path: Column) -> Column:
    """struct<screen_type, language> from names like screen_0003_title_subtitle_bg.png; two-word types are joined."""
    p = F.split(stem(path), "_")
    n = F.size(p)
    two = F.concat_ws("_", F.get(p, F.lit(2)), F.get(p, F.lit(3)))
    joined = (n >= 5) & two.isin("title_subtitle", "list_check")
    kind = F.when(n < 4, "").when(joined, two).otherwise(F.get(p, F.lit(2)))
    rest = F.when(n < 4, F.array().cast("array<string>")).when(joined, F.slice(p, 5, F.greatest(n - 4, F.lit(0)))).otherwise(F.slice(p, 4, F.greatest(n - 3, F.lit(0))))
    return F.struct(kind.alias("screen_type"), F.array_join(rest, "_").alias("language"))


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def points(delta: Column) -> Column:
    return F.format_string("%+.2f pp", delta * 100)


def crop_name(folder: Column, path: Column, index: Column) -> Column:
    return F.concat(folder, F.lit("/"), stem(path), F.lit("__"), F.format_string("%02d", index), F.lit(".png"))


def one_line(text: Column, most: int = 140) -> Column:
    """Line ends as bars, cut to ``most`` characters for a report."""
    t = F.replace(text, F.lit("\n"), F.lit(" | "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def wrapped(text: Column, width: int = 50) -> Column:
    """Lines of at most ``width`` characters."""
    return F.regexp_replace(text, rf"(?s)(.{{{width}}})(?=.)", "$1\n")


def chain(text: Column, *steps) -> Column:
    return reduce(lambda t, f: f(t), steps, text)
