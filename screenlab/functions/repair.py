"""Repair of recognised text by rules on lines, as native expressions.

Every pattern is a fixed value of the rules. Lines are held as arrays; what a rule decides
from several lines is decided from the array as it came, so no state is carried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PRESS_KEY, START_SIGN, bind, strip

LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
TIMER = r"(?iuU)^\s*(\d{1,2})\s*[il|]?\s*[.:]\s*(\d{2})\s*[.:]?\s*$"
BROKEN_TIMER = r"(?iuU)^[\dilohmn\s.:|-]{1,16}$"
PLACEHOLDER = r"(?iuU)^[\-\s1ilhmin]+$"
BADGE = r"(?iuU)^thin[qgd0o]?$"
TOMORROW = r"(?iuU)\bMA(?:li|l|1i|i)\.?(?=\s|$)"
DELAY_WORDS = r"(?iuU)\bEl\s*l?nicio\b|\bEllnicio\b"
SOAKING = r"(?iuU)<PROC_W_S0AKING_PRC"
RINSE = r"(?iuU)^(?:Extra Rinse|Enjuague extra)$"
SCHEDULE = r"(?iuU)\b(?:Iniciar a|Start at)\b"
AT_1230 = r"(?iuU)\b1230\s*((?:a|p)\.?\s*m\.?)\b"
AT_1200 = r"(?iuU)\b12\s*[iIl1oO0]{2,3}\s*((?:a|p)\.?\s*m\.?)\b"
DELAY_ON = r"(?iuU)\b(?:El\s+Inicio\s+retardado|Delay\s+Start\s+is\s+on)\b"
HALF_DAY = r"(?iuU)^\s*([ap])\.?\s*m\.?\s*$"
ZERO_LIKE = "^[0oOdD]$"
PERCENTS = {"100%": ("100", "1000", "1100"), "70%": ("70", "700"), "30%": ("30", "300"), "0%": ("0", "00")}


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def but_last(items: Column) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))


def raw_lines(text: Column) -> Column:
    """Lines as they are; a line end at the very end begins no further one."""
    parts = F.split(text, LINE_END, -1)
    return F.when(last(parts) == "", but_last(parts)).otherwise(parts)


def full_lines(text: Column) -> Column:
    """Lines without white space at their ends, empty ones left out."""
    return F.filter(F.transform(raw_lines(text), strip), lambda l: l != "")


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def start_keys(text: Column) -> Column:
    """The start sign in one form; blanks collapsed, empty lines gone."""
    def one(l):
        l = F.regexp_replace(F.regexp_replace(l, PRESS_KEY, "$1 ▶Ⅱ "), START_SIGN, " ▶Ⅱ ")
        return strip(F.regexp_replace(l, r"[ \t]+", " "))

    return joined(F.filter(F.transform(raw_lines(text), one), lambda l: l != ""))


def schedule_line(line: Column) -> Column:
    """Article, abbreviation and full hours of a start time."""
    fixed = F.regexp_replace(line, r"(?iuU)\bl[áa]s\b", "las")
    fixed = F.regexp_replace(fixed, r"(?iuU)\bMAN\.", "MAÑ.")
    fixed = F.regexp_replace(F.regexp_replace(fixed, AT_1200, "12:00 $1"), AT_1230, "12:30 $1")
    return F.when(line.rlike(SCHEDULE), fixed).otherwise(line)


def known_line(line: Column) -> Column:
    line = F.regexp_replace(F.regexp_replace(line, TOMORROW, "MAÑ."), DELAY_WORDS, "El Inicio")
    line = F.regexp_replace(schedule_line(line), r"(?U)^\s*\+\s*-\s*(\d)\s*$", "+$1")
    line = F.regexp_replace(line, SOAKING, "<PROC_W_SOAKING_PRC")
    return F.when(strip(line).rlike(r"(?iu)^thin\.$"), F.lit("ThinQ AI")).otherwise(line)


def dry_time(lines: Column) -> Column:
    """Below a dry-time heading, letters for zeros and a lost digit before the next choice."""
    return bind(lines, _dry_time)


def _dry_time(lines: Column) -> Column:
    def one(line, i):
        after = F.get(lines, i + 1)
        clean = F.regexp_replace(F.translate(line, "Oo", "00"), r"(?iuU)\bnin\b", "min")
        next_two = F.regexp_extract(after, r"(?iuU)\b(\d{2})\s*min\b", 1)
        expected = F.when(next_two != "", next_two.try_cast("int") + 5)
        tens = F.when(clean.rlike(r"^[0-9]$"), clean.try_cast("int") * 10)
        clean = F.when(tens == expected, expected.cast("string")).otherwise(clean)
        return F.when(line.rlike("(?i)^1[0o]$") & after.rlike(r"(?iuU)\b95\s*min\b"), F.lit("100")).otherwise(clean)

    heads = F.lower(strip(F.get(lines, F.lit(0)))) == "dry time"
    return F.when(heads, F.transform(lines, lambda l, i: F.when(i == 0, l).otherwise(one(l, i)))).otherwise(lines)


def known_tokens(text: Column) -> Column:
    """R2, R3, R4."""
    return joined(dry_time(F.transform(raw_lines(text), known_line)))


def option_tail(text: Column) -> Column:
    """The last choice of an extra-rinse list."""
    hit = lambda ls: (F.size(ls) >= 3) & F.get(ls, F.lit(0)).rlike(RINSE) & last(ls).rlike(ZERO_LIKE)
    return bind(full_lines(text), lambda ls: F.when(hit(ls), joined(F.concat(but_last(ls), F.array(F.lit("0"))))).otherwise(text))


def percent_line(line: Column) -> Column:
    digits = F.regexp_replace(F.translate(F.lower(line), "oul|i", "00111"), "[^0-9]", "")
    out = F.lit(None).cast("string")
    for name, forms in PERCENTS.items():
        out = F.when(digits.isin(*forms), name).otherwise(out)
    return out


def progress(text: Column) -> Column:
    """A lone status, or a status and the first percentage after it."""
    return bind(full_lines(text), lambda ls: _progress(ls, text))


def _progress(ls: Column, text: Column) -> Column:
    only = F.get(ls, F.lit(0))
    lone = F.when(F.lower(only).endswith("actualizar"), "Actualizar").when(F.lower(only).endswith("updating"), "Updating").otherwise(text)
    at = F.array_position(F.transform(ls, lambda l: F.lower(l).isin("updating", "actualizar", "restableciendo")), True)
    status = F.get(ls, (at - 1).cast("int"))
    found = F.get(F.filter(F.transform(F.slice(ls, (at + 1).cast("int"), F.size(ls)), percent_line), lambda p: p.isNotNull()), F.lit(0))
    many = F.when(F.lower(status) == "restableciendo", F.concat_ws("\n", status, found)).otherwise(F.concat_ws("\n", F.lit("UP"), status, found))
    return F.when(F.size(ls) == 0, text).when(F.size(ls) == 1, lone).when((at > 0) & found.isNotNull(), many).otherwise(text)


def badge(text: Column) -> Column:
    """R7."""
    ls = full_lines(text)
    return F.when((F.size(ls) == 1) & F.get(ls, F.lit(0)).rlike(BADGE), F.lit("ThinQ AI")).otherwise(text)


def brand(text: Column) -> Column:
    """R8."""
    return F.regexp_replace(text, r"(?iuU)\bLG\s+Thi(?:n[dgo0]|[o0])\b", "LG ThinQ")


RULES = (start_keys, known_tokens, option_tail, progress, badge, brand)


def repaired(df, column: str, out: str):
    """``df`` with ``out``, all rules in their order.

    Each is a projection of its own: nested, every rule would copy the whole of those before.
    """
    df = df.withColumn(out, F.col(column))
    for rule in RULES:
        df = df.withColumn(out, rule(F.col(out)))
    return df


def compact_timer(line: Column) -> Column:
    """R9: "1:30" and the like as hours and minutes, else null."""
    return F.when(line.rlike(TIMER), F.concat(F.regexp_extract(line, TIMER, 1).cast("int").cast("string"), F.lit(" hr "), F.regexp_extract(line, TIMER, 2), F.lit(" min")))


def broken_timer_at(lines: Column) -> Column:
    """Place (from 1) of the first line that looks like a garbled timer, 0 if none does."""
    return F.array_position(F.transform(lines, lambda l: l.rlike(r"(?U)\d") & F.lower(l).rlike("[hmn]") & l.rlike(BROKEN_TIMER)), True).cast("int")


def placed(lines: Column, at: Column, value: Column) -> Column:
    new = F.struct(at.alias("at"), value.alias("value"))
    return bind(new, lambda n: joined(F.transform(lines, lambda l, i: F.when(i == n["at"] - 1, n["value"]).otherwise(l))))


def repair_timer(primary: Column, compact: Column) -> Column:
    """The garbled timer from the second reading, or the placeholder."""
    return bind(full_lines(primary), lambda ls: _repair_timer(ls, primary, compact))


def _repair_timer(ls: Column, primary: Column, compact: Column) -> Column:
    at = broken_timer_at(ls)
    timer = F.get(F.filter(F.transform(F.transform(raw_lines(compact), strip), compact_timer), lambda t: t.isNotNull()), F.lit(0))
    mid = F.lower(F.get(ls, at - 1))
    blank = mid.rlike(PLACEHOLDER) & mid.contains("h") & mid.rlike("[imn]") & ~mid.rlike(r"(?U)^\s*\d")
    return F.when(at == 0, primary).when(timer.isNotNull(), placed(ls, at, timer)).when(blank, placed(ls, at, F.lit("-- h -- min"))).otherwise(primary)


def any_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda l: l.rlike(pattern))


def misses_option_tail(text: Column) -> Column:
    """An extra-rinse list with +1 but neither +3 nor a zero."""
    ls = full_lines(text)
    rest = F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))
    return F.coalesce(F.get(ls, F.lit(0)).rlike(RINSE) & any_line(rest, r"(?U)^\+\s*1$") & ~any_line(rest, r"(?U)^\+\s*3$") & ~any_line(rest, ZERO_LIKE), F.lit(False))


def recovers_option_tail(primary: Column, candidate: Column) -> Column:
    """A longer reading under the same heading that ends in zero and loses no +n."""
    a, b = full_lines(primary), full_lines(candidate)
    plus = lambda ls: F.size(F.filter(ls, lambda l: l.rlike(r"(?U)^\+\s*\d$")))
    ok = (F.size(b) > F.size(a)) & (F.lower(F.get(a, F.lit(0))) == F.lower(F.get(b, F.lit(0)))) & last(b).rlike(ZERO_LIKE) & (plus(b) >= plus(a))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ok, F.lit(False))


def delay_time(text: Column) -> Column:
    """12:30 or 12:00 from the first line with just these digits."""
    times = F.filter(F.transform(raw_lines(text), lambda l: F.regexp_replace(l, r"(?U)\D", "")), lambda d: d.isin("1230", "1200"))
    first = F.get(times, F.lit(0))
    return F.concat(F.lit("12:"), F.substring(first, 3, 2))


def merge_delay(primary: Column, compact: Column) -> Column:
    """The time beside a lone AM or PM; its style follows the input's case."""
    return bind(full_lines(primary), lambda ls: _merge_delay(ls, primary, compact))


def _merge_delay(ls: Column, primary: Column, compact: Column) -> Column:
    on = F.regexp_replace(joined(ls), DELAY_WORDS, "El Inicio").rlike(DELAY_ON)
    at = F.array_position(F.transform(ls, lambda l: l.rlike(HALF_DAY)), True).cast("int")
    line = F.get(ls, at - 1)
    letter = F.regexp_extract(line, HALF_DAY, 1)
    half = F.when(F.upper(line) == line, F.concat(F.upper(letter), F.lit("M"))).otherwise(F.concat(F.lower(letter), F.lit(".m.")))
    time = delay_time(compact)
    return F.when(on & (at > 0) & time.isNotNull(), placed(ls, at, F.concat_ws(" ", half, time))).otherwise(primary)
