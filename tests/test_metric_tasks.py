"""Steps that all verifications share: figures of periods keep their tasks, places and repeated keys are cheap."""

from pyspark.sql import functions as F

from staycheck.operators import metrics, reconcile
from staycheck.plans import adapters
from tests.test_metrics_split import stays


def test_figures_of_periods_keep_their_tasks(spark):
    declared = spark.createDataFrame([("H-1", "1995-01"), ("H-1", "1995-Q1")], "submission_id string, period string")
    found = metrics.metric_values(stays(spark), None, declared)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_place_of_a_cell_is_worked_out_once(spark):
    rows = spark.createDataFrame(
        [("H-1", "room_nights_sold", "1995-03", None, None), ("H-1", "occupancy_pct", "1996-Q2", None, None),
         ("H-1", "guests_by_nationality", "1997", "nationality", "AU"), ("H-1", "guests_by_nationality", "2001-08", "nationality", "XK")],
        "submission_id string, metric string, period string, dimension string, value_key string").withColumn("value", F.lit(1))
    cells = adapters.in_cells(rows)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 6
    assert [(r.sheet, r.row, r.col, r.cell) for r in cells.collect()] == [
        ("Occupancy", 7, 2, "B7"), ("Occupancy", 110, 4, "D110"), ("Nationality", 6, 204, "GV6"), ("Nationality", 30, 81, "CC30")]


def test_repeated_keys_meet_by_hash(spark):
    claims = spark.createDataFrame(
        [("H-1", "a:1995", "a", "1995", 1), ("H-1", "a:1995", "a", "1995", 2), ("H-2", "a:1995", "a", "1995", 1),
         (None, "b:1995", "b", "1995", 1), (None, "b:1995", "b", "1995", 1), ("H-3", None, None, None, 1)],
        "submission_id string, metric_key string, metric string, period string, value int")
    kept, refused = reconcile.accepted_claims(claims)
    assert "xxhash64" in refused._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r.submission_id or "", r.metric_key, r.metric, r.period, r.detail) for r in refused.collect())) == [
        ("", "b:1995", "b", "1995", "2 claims"), ("H-1", "a:1995", "a", "1995", "2 claims")]
    # a null is no key, so its claims stay
    assert sorted((r.submission_id or "", r.metric_key or "") for r in kept.collect()) == [
        ("", "b:1995"), ("", "b:1995"), ("H-2", "a:1995"), ("H-3", "")]
