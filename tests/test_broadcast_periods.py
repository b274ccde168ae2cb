"""Declared periods and expected months meet by sort and merge, however few Spark takes them for."""

import datetime
import re
from decimal import Decimal

from pyspark.sql import functions as F

from staycheck.operators import intake, metrics
from tests.test_broadcasts import packed
from tests.test_metrics_split import stays
from tests.test_scale import plan


def test_declared_periods_are_not_broadcast(spark, tmp_path):
    declared = packed(tmp_path, spark.createDataFrame(
        [("H-1", "1995-01"), ("H-1", "1995-Q1"), ("H-1", "1995-Q1"), ("H-1", "1995"), ("H-2", "1995-02")], "submission_id string, period string"))
    inv = packed(tmp_path, spark.createDataFrame(
        [("H-1", datetime.date(1995, 1, d), 5, d % 2) for d in (1, 2, 3)], "submission_id string, day date, rooms_total int, rooms_out_of_order int"))
    found = metrics.metric_values(packed(tmp_path, stays(spark)), inv, declared)
    # one broadcast is due: which submissions filed an inventory
    assert not re.search(r"BroadcastHashJoin \[[^\]]*period#", plan(found))
    got = {(r.submission_id, r.metric, r.period, r.value_key): r.computed for r in found.collect() if r.computed is not None}
    assert got == {
        ("H-1", "room_nights_sold", "1995-01", None): 2, ("H-1", "room_nights_sold", "1995-Q1", None): 5, ("H-1", "room_nights_sold", "1995", None): 5,
        **{("H-1", "room_nights_available", p, None): 13 for p in ("1995-01", "1995-Q1", "1995")},
        ("H-1", "occupancy_pct", "1995-01", None): Decimal("15.38"), ("H-1", "occupancy_pct", "1995-Q1", None): Decimal("38.46"),
        ("H-1", "occupancy_pct", "1995", None): Decimal("38.46"), ("H-1", "guests_by_nationality", "1995-01", "DE"): 3,
        **{("H-1", "guests_by_nationality", p, k): n for p in ("1995-Q1", "1995") for k, n in (("DE", 3), (None, 1), ("FR", 1))}}


def test_nationalities_are_dealt_once_for_sums_and_periods(spark):
    """A stay counts once in a quarter or year whose months it touches, and sums stay where their period meets."""
    declared = spark.createDataFrame([("H-1", "1995-01")], "submission_id string, period string")
    rules = metrics.rulesets()
    rows = metrics.period_rows(metrics.month_cube(stays(spark), rules, "nationality_iso2"), rules, "nationality_iso2")
    met = declared.hint("merge").join(rows, ["submission_id", "period"])
    text = plan(met)
    assert text.count("Exchange hashpartitioning(submission_id") + text.count("Exchange hashpartitioning(period") <= 3
    assert met.count() == 1


def test_expected_months_are_not_broadcast(spark, tmp_path):
    files = packed(tmp_path, spark.createDataFrame(
        [("H-1", "pms_1995-01.pdf"), ("H-1", "pms_1995-03.pdf"), ("H-2", "pms_1995-01.pdf"), ("H-2", "pms_1995-01.PDF"), ("H-2", "pms_draft.pdf")],
        "submission_id string, name string"))
    months = packed(tmp_path, spark.createDataFrame([("H-1",), ("H-2",)], "submission_id string")).withColumn(
        "month", F.explode(F.array(F.lit("1995-01"), F.lit("1995-02"))))
    found = intake.file_set_problems(files, months)
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted((r.submission_id, r.problem, r.subject) for r in found.collect()) == [
        ("H-1", "foreign_month", "1995-03"), ("H-1", "missing_month", "1995-02"), ("H-2", "missing_month", "1995-02"),
        ("H-2", "two_for_one_month", "1995-01"), ("H-2", "unnamed_month", "pms_draft.pdf")]
