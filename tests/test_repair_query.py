"""R16 as its SQL has it, for texts that the rules would change, and the rules on whole screens as before."""

from pyspark.sql import functions as F

from screenlab.functions import repair

TEXTS = ["this was.\nThin.\nBy. A of the", "Thin.", "", None, " two  blanks \n\n\nand\tlines \n", "Updating\n30%", "LG Thino again\nMAli. 8:00", "Start at 1230 p.m.", "a\r\nb\x0bc d\n", "Press A l to start", "plain"]


def test_text_below_the_screen_stays(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(20 * n, 20, "user", t) for n, t in enumerate(TEXTS)] + [(n, 3, "user", "x") for n in range(-45, 45)] + [(None, 1, "user", "x"), (1, None, "user", "x")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["R16_repair"]).fetchall(), key=repr)
    assert sorted(map(tuple, entry.queries()["R16_repair"](spark, str(tmp_path)).collect()), key=repr) == want
    assert {"LG ThinQ\n" + (t or "") for t in TEXTS} <= {r[2] for r in want}


def test_rules_still_read_whole_screens(spark):
    screens = [("LG Thino\nthis was.\nThin.\nBy.", "LG ThinQ\nthis was.\nThinQ AI\nBy."), ("LG Thino\n\na  b ", "LG ThinQ\na b"), ("x\nUpdating\n3o%", "UP\nUpdating\n30%")]
    df = repair.repaired(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(screens)], "i int, a string"), "a", "b")
    assert [r["b"] for r in df.orderBy("i").select(F.col("b")).collect()] == [b for _, b in screens]
