"""Stay arithmetic and the recomputed metrics."""

from pyspark.sql import functions as F

from staycheck.catalog.registry import query
from staycheck.operators import metrics as m
from staycheck.plans import adapters as a
from staycheck.session import stage
from staycheck.sources.rulesets import rulesets


def values(spark, sf):
    return m.metric_values(a.reservations(spark, sf), a.inventory(spark, sf),
                           a.declared_periods(spark, sf))


def staged_values(spark, sf):
    """For queries that read them several times."""
    return stage(values(spark, sf))


def staged_claims(spark, sf):
    return stage(a.claims(values(spark, sf)))


@query("prj_01_stay_columns", """
SELECT reservation_id, CAST(departure_date - arrival_date AS INTEGER) AS nights,
  CAST((departure_date - arrival_date) * rooms AS INTEGER) AS room_nights,
  departure_date = arrival_date AS is_day_use, adults + children AS guests FROM v_res""")
def _(spark, sf):
    res = a.reservations(spark, sf).drop("nights", "room_nights")
    return m.with_stay_columns(res).select(
        "reservation_id", "nights", "room_nights", "is_day_use", "guests")


@query("flt_01_qualifying", """
SELECT reservation_id, status, rate_code FROM v_res
WHERE status IN ('CHECKED_OUT','IN_HOUSE') AND rate_code IN ('BAR','CORP','GOV','OTA','GROUP','COMP')""")
def _(spark, sf):
    return m.qualifying(a.reservations(spark, sf), rulesets()[0]).select(
        "reservation_id", "status", "rate_code")


@query("sc_05_occupied_nights", """
SELECT submission_id, strftime(night, '%Y-%m-%d') AS night, count(*) AS stays FROM (
  SELECT submission_id, CAST(unnest(generate_series(arrival_date, departure_date - 1,
    INTERVAL 1 DAY)) AS DATE) AS night FROM v_res WHERE departure_date > arrival_date)
GROUP BY ALL""")
def _(spark, sf):
    return m.occupied_nights(a.reservations(spark, sf)).groupBy(
        "submission_id", F.date_format("night", "yyyy-MM-dd").alias("night")).agg(
        F.count("*").alias("stays"))


@query("jn_02_apportion", """
SELECT reservation_id, period AS month, rooms * nights_in AS room_nights_in
FROM v_touch WHERE kind = 'month'""")
def _(spark, sf):
    return m.stay_months(a.reservations(spark, sf)).select(
        "reservation_id", F.date_format("month", "yyyy-MM").alias("month"),
        (F.col("rooms") * F.col("nights_in")).alias("room_nights_in"))


@query("ag_01_room_nights_sold", """
SELECT submission_id, period, CAST(v AS DOUBLE) AS sold FROM v_base
WHERE metric = 'room_nights_sold' AND v IS NOT NULL""")
def _(spark, sf):
    return _metric(spark, sf, "room_nights_sold", "sold")


def _metric(spark, sf, metric, name):
    return values(spark, sf).filter((F.col("metric") == metric) & F.col("computed").isNotNull()
                                    ).select("submission_id", "period",
                                             F.col("computed").cast("double").alias(name))


@query("ag_02_room_nights_available", """
SELECT submission_id, period, days, net, gross FROM v_invp""")
def _(spark, sf):
    return m.inventory_periods(a.inventory(spark, sf)).select(
        "submission_id", "period", "days", "net", "gross")


@query("ag_03_room_count", "SELECT submission_id, period, max_net, max_gross FROM v_invp")
def _(spark, sf):
    return m.inventory_periods(a.inventory(spark, sf)).select(
        "submission_id", "period", "max_net", "max_gross")


@query("jn_03_inventory_days_in_period", """
SELECT i.submission_id, p.period, strftime(i.day, '%Y-%m-%d') AS day, i.rooms_total
FROM v_inv i JOIN v_periods p ON i.day BETWEEN p.first_day AND p.last_day""")
def _(spark, sf):
    from staycheck.functions import periods
    return a.inventory(spark, sf).select(
        "submission_id", F.explode(periods.periods_of_month(F.col("day"))).alias("period"),
        F.date_format("day", "yyyy-MM-dd").alias("day"), "rooms_total")


@query("ag_04_occupancy_ratio", """
SELECT i.submission_id, i.period, CASE WHEN net = 0 THEN 0.0
  ELSE 100.0::DOUBLE * coalesce(sold, 0)::DOUBLE / net::DOUBLE END AS ratio
FROM v_invp i LEFT JOIN v_sold s ON s.submission_id = i.submission_id AND s.period = i.period
  AND s.ruleset_id = 'BASELINE'""")
def _(spark, sf):
    base = rulesets()[:1]
    sold = m.period_rows(m.month_cube(a.reservations(spark, sf), base), base)
    name = next(c for c in sold.columns if c.startswith("s_"))
    inv = m.inventory_periods(a.inventory(spark, sf))
    n = F.coalesce(F.col(name), F.lit(0)).cast("double")
    return inv.join(sold, ["submission_id", "period"], "left").select(
        "submission_id", "period",
        F.when(F.col("net") == 0, 0.0).otherwise(F.lit(100.0) * n / F.col("net").cast("double"))
        .alias("ratio"))


@query("ag_05_occupancy_pct", """
SELECT submission_id, period, CAST(v AS DOUBLE) AS occupancy FROM v_base
WHERE metric = 'occupancy_pct' AND v IS NOT NULL""")
def _(spark, sf):
    return _metric(spark, sf, "occupancy_pct", "occupancy")


@query("ag_06_guests_by_nationality", """
SELECT submission_id, period, value_key, CAST(v AS DOUBLE) AS guests FROM v_base
WHERE metric = 'guests_by_nationality' AND v IS NOT NULL""")
def _(spark, sf):
    return values(spark, sf).filter(
        (F.col("metric") == "guests_by_nationality") & F.col("computed").isNotNull()).select(
        "submission_id", "period", "value_key", F.col("computed").cast("double").alias("guests"))


@query("ag_07_guest_periods", """
SELECT reservation_id, period AS month, arrives AS by_arrival, departs AS by_departure,
  nights_in > 0 OR (nights = 0 AND arrives) AS by_night FROM v_touch WHERE kind = 'month'""")
def _(spark, sf):
    return m.stay_months(a.reservations(spark, sf)).select(
        "reservation_id", F.date_format("month", "yyyy-MM").alias("month"),
        F.col("arrives").alias("by_arrival"), F.col("departs").alias("by_departure"),
        F.col("stays").alias("by_night"))


@query("ag_08_compute_all", """
SELECT submission_id, metric_key, CAST(v AS DOUBLE) AS value, nv AS reason FROM v_base""")
def _(spark, sf):
    return values(spark, sf).filter("computed is not null or nv_reason is not null").select(
        "submission_id", "metric_key", F.col("computed").cast("double").alias("value"),
        F.col("nv_reason").alias("reason"))


@query("ag_09_compute_permuted", """
SELECT submission_id, metric_key, ruleset_id, CAST(v AS DOUBLE) AS value FROM v_perm""")
def _(spark, sf):
    return m.permuted_values(values(spark, sf)).select(
        "submission_id", "metric_key", "ruleset_id", F.col("value").cast("double").alias("value"))


@query("jn_04_measures_by_ruleset", """
SELECT ruleset_id, metric, count(*) AS keys, CAST(sum(v) AS DOUBLE) AS total
FROM v_perm GROUP BY ALL""")
def _(spark, sf):
    perm = m.permuted_values(values(spark, sf))
    return perm.groupBy("ruleset_id", F.substring_index("metric_key", ":", 1).alias("metric")).agg(
        F.count("*").alias("keys"), F.sum("value").cast("double").alias("total"))


@query("src_08_ruleset_qualifying", """
SELECT q.ruleset_id, q.ord, count(*) AS qualifying FROM v_rules q JOIN v_res r
  ON list_contains(q.status_in, r.status) AND list_contains(q.rate_in, r.rate_code)
GROUP BY ALL""")
def _(spark, sf):
    from staycheck.sources.rulesets import rulesets_table
    seen = a.reservations(spark, sf).groupBy("status", "rate_code").agg(F.count("*").alias("n"))
    rules = rulesets_table(spark).select(
        "ruleset_id", "ord", F.explode("status_in").alias("status"), "rate_in").select(
        "ruleset_id", "ord", "status", F.explode("rate_in").alias("rate_code"))
    return seen.join(rules, ["status", "rate_code"]).groupBy("ruleset_id", "ord").agg(
        F.sum("n").alias("qualifying"))
