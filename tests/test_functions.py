"""Hand-derived examples and properties of the scalar functions."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.functions import geometry, imaging, repair, text


def values(spark, rows, schema, *columns):
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in got]


def test_normal_forms(spark):
    rows = [("  a  b\n",), (None,), ("é‏x",), ("a\x1cb",), ("ﬁ Press ▶ f| to go",), ("▶ II x",)]
    got = values(spark, rows, "t string", text.normalize_nfc(F.col("t")), text.normalize_nfkc(F.col("t")))
    assert [g[0] for g in got[:4]] == ["a b", "", "éx", "a b"]
    assert got[4][1] == "fi Press ▶II to go" and got[5][1] == "▶II x"


def test_rates(spark):
    rows = [("", ""), ("", "x"), ("abc", "abd"), ("ab", "abcdef"), ("Сильно", "Средне"), ("", "abc")]
    got = values(spark, rows, "r string, h string", text.cer(F.col("r"), F.col("h")), text.cer_floor(F.col("r"), F.col("h")))
    assert [g[0] for g in got] == pytest.approx([0, 1, 1 / 3, 2.0, 4 / 6, 1])
    assert got[5][1] == 3.0
    got = values(spark, [("", ""), ("", "x y"), ("a b c", "a x c"), ("a", "")], "r string, h string", text.wer(F.col("r"), F.col("h")))
    assert got == pytest.approx([0, 1, 1 / 3, 1])


def test_word_distance_agrees_with_a_table(spark):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["a", "b", "é", "中", "😀x"], k=rng.randrange(1, 9))), " ".join(rng.choices(["a", "b", "é", "q"], k=rng.randrange(1, 9)))) for _ in range(60)]
    got = values(spark, rows, "r string, h string", text.wer(F.col("r"), F.col("h")))
    assert got == pytest.approx([edit(r.split(" "), h.split(" ")) / len(r.split(" ")) for r, h in rows])
    many = (" ".join(f"w{i}" for i in range(6500)), " ".join(f"w{i}" for i in range(1, 6500)))
    assert values(spark, [many], "r string, h string", text.wer(F.col("r"), F.col("h"))) == pytest.approx([1 / 6500])


def test_buckets_and_names(spark):
    assert values(spark, [(x,) for x in (0.05, 0.0501, 0.20, 0.2001)], "c double", text.verdict(F.col("c"))) == ["PASS", "WARN", "WARN", "FAIL"]
    assert values(spark, [(x,) for x in (0.19, 0.2, 0.5)], "c double", text.severity(F.col("c"))) == ["green", "orange", "red"]
    assert values(spark, [(x,) for x in (17, 18, 31, 32, 59, 60)], "p int", text.size_class(F.col("p"))) == ["small", "medium", "medium", "large", "large", "xl"]
    assert values(spark, [("bg",), ("zh_tw",), ("xx",), (None,)], "l string", text.script_of(F.col("l"))) == ["cyrillic", "chinese_traditional", "other", "other"]
    names = ["screen_0003_title_subtitle_bg.png", "screen_0004_list_check_bg.png", "screen_7_toast_zh_cn.png", "screen_1_title_subtitle.png", "x.png"]
    got = values(spark, [(n,) for n in names], "p string", text.filename_parts(F.col("p")))
    assert [tuple(g) for g in got] == [("title_subtitle", "bg"), ("list_check", "bg"), ("toast", "zh_cn"), ("title", "subtitle"), ("", "")]
    got = values(spark, [("a/b.c.png",), (".hidden",), ("a/",)], "p string", text.stem(F.col("p")), text.suffix(F.col("p")), text.leaf(F.col("p")))
    assert got == [("b.c", ".png", "b.c.png"), (".hidden", "", ".hidden"), ("", "", "")]


REPAIRS = [
    ("Press A l to start", "Press ▶Ⅱ to start"), ("a\n\n  b\tc ", "a\nb c"), ("+ - 2", "+2"), ("+ 2", "+ 2"), ("Start at 1230 p.m.", "Start at 12:30 p.m."),
    ("Iniciar a lás 12OO am MAN.", "Iniciar a las 12:00 am MAÑ."), ("Dry Time\n9\n85 min", "Dry Time\n90\n85 min"), ("Dry Time\n10\n95 min", "Dry Time\n100\n95 min"),
    ("Dry Time\n4O nin", "Dry Time\n40 min"), ("Extra Rinse\n+1\nO", "Extra Rinse\n+1\n0"), ("XX\nUpdating\n1oo%", "UP\nUpdating\n100%"), ("Restableciendo\n30", "Restableciendo\n30%"),
    ("v Updating", "Updating"), ("Thind", "ThinQ AI"), ("thin.", "ThinQ AI"), ("LG Thino", "LG ThinQ"), ("LG ThinQ", "LG ThinQ"), ("Ellnicio MAli", "El Inicio MAÑ."), ("", ""), ("Updating\nxx", "Updating\nxx"),
]


def test_repairs(spark):
    frame = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(REPAIRS)], "i int, a string")
    got = [(r["a"], r["c"]) for r in repair.repaired(frame, "a", "c").orderBy("i").collect()]
    assert got == REPAIRS


def test_second_readings(spark):
    assert values(spark, [("1:30",), ("02.05",), ("1:3",)], "t string", repair.compact_timer(F.col("t"))) == ["1 hr 30 min", "2 hr 05 min", None]
    rows = [("Normal\n1h3om\nWashing", "1:30"), ("--1h--1min", ""), ("Normal", "1:30")]
    assert values(spark, rows, "a string, b string", repair.repair_timer(F.col("a"), F.col("b"))) == ["Normal\n1 hr 30 min\nWashing", "-- h -- min", "Normal"]
    rows = [("Delay Start is on\nAM", "1230"), ("Delay Start is on\np.m.", "12:30"), ("x\nAM", "1230"), ("Delay Start is on\nAM", "")]
    assert values(spark, rows, "a string, b string", repair.merge_delay(F.col("a"), F.col("b"))) == ["Delay Start is on\nAM 12:30", "Delay Start is on\np.m. 12:30", "x\nAM", "Delay Start is on\nAM"]
    assert values(spark, [("Extra Rinse\n+ 1",), ("Extra Rinse\n+1\n+3",), ("x\n+1",), ("",)], "t string", repair.misses_option_tail(F.col("t"))) == [True, False, False, False]
    rows = [("Extra Rinse\n+1", "extra rinse\n+1\nO"), ("Extra Rinse\n+1", "Extra Rinse\nO"), ("", "")]
    assert values(spark, rows, "a string, b string", repair.recovers_option_tail(F.col("a"), F.col("b"))) == [True, False, False]


def test_line_fold(spark):
    schema = "b array<struct<y:double,x:double,text:string>>"
    rows = [([(10.0, 0.0, "a"), (20.0, 1.0, "b"), (31.0, 2.0, "c")],), ([(10.0, 0.0, "a"), (20.0, 1.0, "b"), (27.0, 0.0, "c")],), ([],)]
    assert values(spark, rows, schema, geometry.text_of(geometry.lines(F.col("b")))) == ["a b\nc", "a c b", ""]


def box(x1, y1, x2, y2, t, s=1.0):
    return ([[float(x1), float(y1)], [float(x2), float(y1)], [float(x2), float(y2)], [float(x1), float(y2)]], t, s)


def test_icons_are_dropped_only_beside_text(spark):
    schema = "b array<struct<bbox:array<array<double>>,text:string,score:double>>"
    rows = [([box(5, 100, 20, 115, "oO", 0.5), box(60, 100, 120, 116, "Normal", 0.9)],), ([box(5, 100, 20, 115, "oO", 0.5)],), ([box(5, 5, 40, 40, "UP"), box(60, 100, 120, 116, "Updating")],), ([],)]
    got = values(spark, rows, schema, geometry.boxes_to_text(F.col("b")))
    assert [tuple(g) for g in got] == [("Normal", 0.9), ("oO", 0.5), ("Updating", 1.0), ("", 0.0)]
    assert values(spark, rows, schema, geometry.corners_to_text(F.col("b")))[0] == "oO Normal"
    rows = [([box(0, 0, 1, 1, "a", 0.5)], [box(0, 0, 1, 1, "b", 0.5), box(0, 0, 1, 1, "c", 0.6)]), ([], []), ([box(0, 0, 1, 1, "a", 0.9)], [box(0, 0, 1, 1, "b", 0.5)] * 2)]
    two = f"{schema}, c array<struct<bbox:array<array<double>>,text:string,score:double>>"
    assert values(spark, rows, two, F.size(geometry.select_result(F.col("b"), F.col("c")))) == [2, 0, 1]


def test_boxes(spark):
    w, h = F.lit(320), F.lit(240)
    got = values(spark, [([0, 0, 3, 3],), ([10, 10, 10, 10],), ([1, 2, 3],)], "b array<int>", geometry.crop_box(F.col("b"), w, h))
    assert got == [None, [6, 6, 14, 14], None]
    got = values(spark, [([0, 0, 8, 2],), ([0, 0, 8, 3],), ([-5, 0, 3, 6],)], "b array<int>", geometry.polygon_box(F.col("b"), w, h), geometry.corners(geometry.polygon_box(F.col("b"), w, h)))
    assert [g[0] for g in got] == [None, [0, 0, 8, 3], [0, 0, 3, 6]] and got[1][1] == [[0, 0], [8, 0], [8, 3], [0, 3]]


def test_image_stages():
    image = np.zeros((40, 60, 3), np.uint8)
    image[10:14, 20:40] = (10, 200, 30)
    assert imaging.to_gray(image).max() == 200 and imaging.to_gray(image[..., 0]).ndim == 2
    found = dict(imaging.stages(image))
    assert list(found) == ["gray", "tophat", "clahe", "invert", "pad"]
    assert found["tophat"][11, 30] == 200 and found["pad"].shape == (80, 100) and found["pad"][0, 0] == 255
    assert (imaging.crop(image, [20, 10, 40, 14])[..., 1] == 200).all()
    assert (imaging.from_image_row(40, 60, 3, image.tobytes()) == image).all()


def test_unicode_form_is_nfc(spark):
    rng = random.Random(1)
    rows = [("".join(chr(rng.choice([0x41, 0x301, 0x65, 0x212B, 0x1100, 0x1161, 0x20])) for _ in range(12)),) for _ in range(50)]
    assert values(spark, rows, "t string", text.unicode_form("NFC")(F.col("t"))) == [unicodedata.normalize("NFC", r[0]) for r in rows]
