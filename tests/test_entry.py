"""The driver's contract, and lists whose numbers and texts are fixed by the rules."""

import pytest

from screenlab.operators import dataset


def test_entry_runs(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["key", "n", "mean_cer", "mean_wer"] and got.count() > 0


def test_crops_count_every_element(spark):
    rows = [("d/s_1.png", [320, 240], [("icon", [0, 0, 9, 9], None), ("text", [10, 10, 60, 30], " Café \n"), ("text", [330, 40, 340, 50], "off the canvas"), ("text", [10, 60, 60, 80], None), ("text", [0, 90, 60, 110], "b")])]
    labels = spark.createDataFrame(rows, "image_path string, canvas_size array<int>, elements array<struct<type:string,bbox:array<int>,text:string>>")
    known = dataset.dictionary_column(spark.createDataFrame([(c,) for c in "Café"], "ch string"))
    got = {r["crop_path"]: (r["text"], r["box"], r["known"]) for r in dataset.recognition_list(labels, known).collect()}
    assert got == {"crops/s_1__01.png": ("Café", [6, 6, 64, 34], True), "crops/s_1__04.png": ("b", [0, 86, 64, 114], False)}


@pytest.mark.parametrize("kind", ["queries", "oracle_sql"])
def test_names(kind):
    import __spark_entry__ as entry

    assert all(callable(v) or v.strip() for v in getattr(entry, kind)().values())
