"""Inventory lines: a line filled up to the schema's columns reads as it did, and headers are read once a file."""

import itertools

from pyspark.sql import functions as F

from staycheck.sources import readers


def test_filled_lines_read_as_they_are(spark):
    cells = ["", "a", " b ", '""', '"c, d"', '"e', 'f"', '"g"h', '"i" ', ' "j"', '"k""l"', '"m\\"n"', "o\\", '"p\\"', "\t", "#", "é "]
    lines = [",".join(x) for n in (1, 2, 3) for x in itertools.product(cells, repeat=n)]
    lines += [",".join(["x"] * n) for n in (63, 64, 65, 90)] + [",".join(['"y,"'] * n) for n in (63, 64, 65)] + ["," * 62, "," * 63, "," * 64]
    df = spark.createDataFrame([(x,) for x in lines], "value string").filter("trim(value) <> ''")
    schema = ", ".join(f"c{i} string" for i in range(readers.MAX_COLUMNS))
    was = F.from_csv("value", F.lit(schema))
    both = df.select("value", readers._cells().alias("now"), F.array(*[was[f"c{i}"] for i in (0, 1, 2, 3, 62, 63)]).alias("was"))
    wrong = both.filter(~F.array(*[F.get("now", F.lit(i)) for i in (0, 1, 2, 3, 62, 63)]).eqNullSafe(F.col("was")))
    assert wrong.select("value").collect() == []


def test_plain_lines_have_the_columns_of_the_schema(spark):
    rows = [("H-1,1995-01-01,5,0",), ('"a, b",1995-01-01,5,""',), (",".join("x" * 64),)]
    df = spark.createDataFrame(rows, "value string").select(readers._filled().alias("v"))
    schema = ", ".join([f"c{i} string" for i in range(readers.MAX_COLUMNS)] + ["bad string"])
    assert df.select(F.from_csv("v", F.lit(schema), {"columnNameOfCorruptRecord": "bad"})["bad"].alias("bad")).filter(
        "bad is not null").count() == 0


def test_headers_are_read_once_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,hotel_id,rooms_total,rooms_out_of_order\n1995-01-01,H-1,5,0\n1995-01-02,H-1,6,1\n")
    read = readers.read_inventory(spark, str(tmp_path))
    text = read._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in text.split("Join Inner")[0]
    assert sorted((r.submission_id, r.row_no, r.rooms_total) for r in read.collect()) == [("H-1", 1, 5), ("H-1", 2, 6)]
