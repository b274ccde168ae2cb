"""Figures of periods and of nationalities are worked out apart."""

import re

from pyspark.sql import functions as F

from staycheck.operators import metrics

STAYS = ("submission_id string, reservation_id string, nationality_iso2 string, adults int, children int, rooms int, "
         "room_nights int, arrival_date date, departure_date date, status string, rate_code string")


def stays(spark):
    rows = [("H-1", "r1", "DE", 2, 1, 1, 3, "1995-01-30", "1995-02-02", "CHECKED_OUT", "BAR"),
            ("H-1", "r2", None, 1, 0, 1, 1, "1995-02-03", "1995-02-04", "CHECKED_OUT", "BAR"),
            ("H-1", "r3", "FR", 1, 0, 1, 1, "1995-03-03", "1995-03-04", "CHECKED_OUT", "BAR")]
    raw = spark.createDataFrame(rows, STAYS.replace(" date", " string"))
    return raw.withColumns({c: F.to_date(c) for c in ("arrival_date", "departure_date")})


def test_periods_and_nationalities(spark):
    declared = spark.createDataFrame([("H-1", p) for p in ("1995-01", "1995-02", "1995-Q1", "1995-Q1", "1995-07")],
                                     "submission_id string, period string")
    got = {(r.metric, r.period, r.value_key): (r.computed, r.nv_reason) for r in
           metrics.metric_values(stays(spark), None, declared).collect()}
    figures = {k: v[0] for k, v in got.items() if v[0] is not None}
    assert figures == {("room_nights_sold", "1995-01", None): 2, ("room_nights_sold", "1995-02", None): 2,
                       ("room_nights_sold", "1995-Q1", None): 5, ("guests_by_nationality", "1995-01", "DE"): 3,
                       ("guests_by_nationality", "1995-02", None): 1,
                       ("guests_by_nationality", "1995-Q1", "DE"): 3, ("guests_by_nationality", "1995-Q1", None): 1,
                       ("guests_by_nationality", "1995-Q1", "FR"): 1}
    assert got["room_nights_sold", "1995-07", None] == (None, "no_source_rows")
    assert got["occupancy_pct", "1995-Q1", None] == (None, "missing_inventory_reference")


def test_code_is_small_enough_to_compile(spark):
    """The JVM leaves methods of more than 8000 bytes to its interpreter."""
    declared = spark.createDataFrame([("H-1", "1995-01")], "submission_id string, period string")
    inv = spark.sql("select 'H-1' as submission_id, date'1995-01-01' as day, 5 as rooms_total, 0 as rooms_out_of_order")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = metrics.metric_values(stays(spark), inv, declared)
        code = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000
