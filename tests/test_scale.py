"""What only shows in plans and partitions: expanded rows stay out of broadcasts and out of single tasks."""

import datetime

from pyspark.sql import functions as F

from staycheck.operators import checks, evidence
from staycheck.session import spread
from staycheck.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days(spark):
    first, last = (F.lit(datetime.date(y, m, d)) for y, m, d in ((1995, 1, 1), (1995, 3, 31)))
    rows = spark.createDataFrame([("H-1", "a.csv"), ("H-2", "a.csv")], "submission_id string, file string")
    return rows.withColumn("day", F.explode(F.sequence(first, last))).withColumn("row_no", F.dayofyear("day")).filter(
        "day <> date'1995-02-03'")


def test_expanded_days_are_not_broadcast(spark):
    declared = spark.createDataFrame([("H-1", "1995-02"), ("H-1", "1995-Q1"), ("H-3", "1995-02")], "submission_id string, period string")
    gaps = checks.inventory_gaps(days(spark), declared)
    assert "SortMergeJoin [submission_id" in plan(gaps) and "day#" in plan(gaps).split("SortMergeJoin")[1].split("\n")[0]
    assert [tuple(r) for r in gaps.collect()] == [("H-1", datetime.date(1995, 2, 3))]


def test_cited_days_are_not_broadcast(spark):
    findings = spark.createDataFrame([("H-1", "room_nights_available:1995-Q1", "room_nights_available", "1995-Q1", 1)],
                                     "submission_id string, metric_key string, metric string, period string, computed int"
                                     ).withColumn("explaining_permutation", F.lit(None).cast("string"))
    cited = evidence.inventory_evidence(findings, days(spark))
    assert "SortMergeJoin" in plan(cited) and "BroadcastHashJoin" not in plan(cited)
    assert sorted((r.row_start, r.row_end) for r in cited.collect()) == [(1, 33), (35, 90)]


def test_few_rows_are_dealt_over_tasks(spark):
    rows = spread(spark.range(100).distinct(), "id")
    assert rows.rdd.getNumPartitions() == min(3 * spark.sparkContext.defaultParallelism, 4)
    assert rows.count() == 100


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n" + "Day,hotel_id,rooms_total,rooms_out_of_order\n\n1995-01-01,H-1,5,0\n1995-01-02,H-1,\"6\",1\n")
    (tmp_path / "b.csv").write_text("﻿day,hotel_id,rooms_total\n1995-01-01,H-2,5\n")
    read = readers.read_inventory(spark, str(tmp_path))
    text = read._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= text.count("from_csv") <= 4
    assert sorted((r.submission_id, r.row_no, r.rooms_total, r.rooms_out_of_order) for r in read.collect()) == [
        ("H-1", 1, 5, 0), ("H-1", 2, 6, 1)]
    assert [(r.file, r.missing, r.repeated) for r in readers.inventory_defects(spark, str(tmp_path)).collect()] == [
        ("b.csv", ["rooms_out_of_order"], [])]
