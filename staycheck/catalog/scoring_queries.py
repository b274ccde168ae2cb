"""Planted errors, expectations, scores; sources that go through files."""

from pyspark.sql import functions as F

from staycheck import values as v
from staycheck.catalog.metric_queries import staged_values, values
from staycheck.catalog.reconcile_queries import findings, num
from staycheck.catalog.registry import query
from staycheck.catalog.verdict_queries import NARRATIVE_PROBLEMS, sourced
from staycheck.operators import checks
from staycheck.operators import review as rv
from staycheck.operators import scoring as sc
from staycheck.plans import adapters as a
from staycheck.session import shared_dir, spread, stage
from staycheck.sources import readers


def base(spark, sf):
    return a.baseline_claims(values(spark, sf))


@query("ag_20_quarter_rollup", """
SELECT submission_id, metric, coalesce(value_key, '') AS value_key, quarter AS period,
  CAST(sum(v) AS DOUBLE) AS value, count(*) AS months
FROM v_base b JOIN v_months m ON m.month = b.period
WHERE v IS NOT NULL AND metric <> 'occupancy_pct' GROUP BY ALL""")
def _(spark, sf):
    return sc.quarter_rollup(base(spark, sf)).select(
        "submission_id", "metric", F.coalesce("value_key", F.lit("")).alias("value_key"), "period",
        num("value"), "months")


T = """CASE WHEN v >= 10 AND substring(CAST(CAST(v AS BIGINT) AS VARCHAR), 1, 1) <>
  substring(CAST(CAST(v AS BIGINT) AS VARCHAR), 2, 1) THEN CAST(
    substring(CAST(CAST(v AS BIGINT) AS VARCHAR), 2, 1) ||
    substring(CAST(CAST(v AS BIGINT) AS VARCHAR), 1, 1) ||
    substring(CAST(CAST(v AS BIGINT) AS VARCHAR), 3) AS DECIMAL(38,10)) END"""


@query("prj_30_transpose", f"""
WITH t AS (SELECT b.*, m.quarter, value_key = 'DE' AND length(period) = 7 AND period LIKE '%-01'
    AND {T} IS NOT NULL AS hit, {T} AS swapped
  FROM v_base b LEFT JOIN v_months m ON m.month = b.period WHERE v IS NOT NULL),
n AS (SELECT *, CASE WHEN hit THEN swapped ELSE v END AS nv_ FROM t),
q AS (SELECT submission_id, metric, value_key, quarter, sum(nv_) AS s FROM n
  WHERE quarter IS NOT NULL AND value_key = 'DE' GROUP BY ALL HAVING bool_or(hit))
SELECT n.submission_id, n.metric_key, CAST(coalesce(q.s, n.nv_) AS DOUBLE) AS value FROM n
LEFT JOIN q ON q.submission_id = n.submission_id AND q.metric = n.metric
  AND q.value_key = n.value_key AND q.quarter = n.period AND n.quarter IS NULL""")
def _(spark, sf):
    from staycheck.functions.text import transpose_digits
    january = (F.col("value_key") == "DE") & F.col("period").rlike("^[0-9]{4}-01$")
    target = january & transpose_digits(F.col("value")).isNotNull()
    return sc.mutate_claims(base(spark, sf), "transpose_digits", target).select(
        "submission_id", "metric_key", num("value"))


@query("prj_30_recompute_under", """
SELECT b.submission_id, b.metric_key, CAST(coalesce(p.v, b.v) AS DOUBLE) AS value
FROM v_base b LEFT JOIN v_perm p ON p.submission_id = b.submission_id
  AND p.metric_key = b.metric_key AND p.ruleset_id = 'P-OCC-DENOM-ROOMS' WHERE b.v IS NOT NULL""")
def _(spark, sf):
    return sc.mutate_claims(base(spark, sf), "recompute_under", F.col("metric") == "occupancy_pct",
                            permutation="P-OCC-DENOM-ROOMS").select(
        "submission_id", "metric_key", num("value"))


@query("prj_30_delete_dimension", """
SELECT submission_id, metric_key FROM v_base WHERE v IS NOT NULL AND coalesce(value_key, '') <> 'KZ'""")
def _(spark, sf):
    return sc.mutate_claims(base(spark, sf), "delete_dimension", F.col("value_key") == "KZ").select(
        "submission_id", "metric_key")


@query("prj_30_relabel", """
SELECT submission_id, label, count(*) AS claims FROM (SELECT submission_id,
  CASE value_key WHEN 'PL' THEN 'Mongolia' WHEN 'CZ' THEN 'Czechia' ELSE 'other' END AS label
  FROM v_base WHERE v IS NOT NULL AND value_key IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    out = sc.mutate_claims(base(spark, sf), "relabel", F.col("value_key") == "PL",
                           new_label="Mongolia").filter("value_key is not null")
    label = F.when(F.col("label").isin("Mongolia", "Czechia"), F.col("label")).otherwise("other")
    return out.groupBy("submission_id", label.alias("label")).agg(F.count("*").alias("claims"))


@query("jn_23_derive_expected", """
SELECT coalesce(c.submission_id, b.submission_id) AS submission_id,
  coalesce(c.metric_key, b.metric_key) AS metric_key, CASE WHEN c.value IS NULL OR b.v IS NULL
    THEN 'V5' ELSE 'V1' END AS variance_class, CAST(c.value AS DOUBLE) AS claimed,
  CAST(b.v AS DOUBLE) AS computed, CAST(c.value - b.v AS DOUBLE) AS difference
FROM v_claims c FULL JOIN (SELECT * FROM v_base WHERE v IS NOT NULL) b
  ON c.submission_id = b.submission_id AND c.metric_key = b.metric_key
WHERE c.value IS NULL OR b.v IS NULL OR abs(c.value - b.v)
  > CASE WHEN c.metric = 'occupancy_pct' THEN 0.10 ELSE 0 END""")
def _(spark, sf):
    metrics = staged_values(spark, sf)
    return sc.derive_expected(a.claims(metrics), a.baseline_claims(metrics), "V1").select(
        "submission_id", "metric_key", "variance_class", num("claimed"), num("computed"),
        num("difference"))


EXPECTED = """
WITH f AS (SELECT *, CAST(finding_id[3:6] AS INTEGER) AS n,
  CASE WHEN variance_class = 'V2' THEN 'definitional_items' ELSE 'findings' END AS list FROM v_find),
s AS (
  SELECT submission_id AS fixture_id, list, metric_key, CASE WHEN n % 10 = 0 OR n % 17 = 0
      THEN 'unexpected' ELSE 'compared' END AS outcome,
    CASE WHEN n % 10 = 0 OR n % 17 = 0 THEN '' ELSE array_to_string([x FOR x IN [
      CASE WHEN n % 11 = 0 AND variance_class <> 'V7' THEN 'variance_class' END,
      CASE WHEN n % 13 = 0 AND claimed IS NOT NULL THEN 'claimed' END] IF x IS NOT NULL], ',') END
      AS differs, severity, CASE WHEN n % 10 = 0 OR n % 17 = 0 THEN severity ELSE severity END AS sv
  FROM f
  UNION ALL SELECT submission_id, list, metric_key || '?', 'missing', '', severity, severity FROM f
  WHERE n % 17 = 0 AND n % 10 <> 0)
"""


def scores(spark, sf):
    f = stage(findings(spark, sf))
    observed = f.withColumns({
        "fixture_id": F.col("submission_id"),
        "list": F.when(F.col("variance_class") == "V2", "definitional_items").otherwise("findings")})
    return observed, a.expected_findings(f)


@query("jn_22_score_findings", EXPECTED
       + "SELECT fixture_id, list, metric_key, outcome, differs FROM s")
def _(spark, sf):
    observed, expected = scores(spark, sf)
    return sc.score_findings(observed, expected).select(
        "fixture_id", "list", "metric_key", "outcome", F.concat_ws(",", "differs").alias("differs"))


@query("so_03_key_sets", EXPECTED + """
SELECT fixture_id, list, metric_key, outcome AS side FROM s WHERE outcome <> 'compared'""")
def _(spark, sf):
    return sc.key_set_differences(*scores(spark, sf))


@query("ag_23_tally", EXPECTED + """
SELECT *, material_matched / material_expected AS recall, class_matched / class_expected AS class_rate
FROM (SELECT count(*) FILTER (outcome <> 'unexpected' AND severity = 'material') AS material_expected,
  count(*) FILTER (outcome = 'compared' AND severity = 'material'
    AND NOT contains(differs, 'variance_class')) AS material_matched,
  count(*) FILTER (outcome <> 'unexpected') AS class_expected,
  count(*) FILTER (outcome = 'compared' AND NOT contains(differs, 'variance_class')) AS class_matched,
  count(*) FILTER (outcome = 'unexpected') AS false_positives,
  count(*) FILTER (outcome = 'unexpected' AND CAST(fixture_id[3:] AS INTEGER) % 2 = 0)
    AS control_false_positives FROM s)""")
def _(spark, sf):
    observed, expected = scores(spark, sf)
    controls = a.hotels(spark, sf).filter("hotel_no % 2 = 0").select(
        F.col("submission_id").alias("fixture_id"))
    return sc.tally(sc.score_findings(observed, expected), controls)


@query("ag_23_rates", f"""
SELECT submission_id, findings, openable, graded AS narratives_graded, passed AS narratives_passed,
  openable / findings AS openable_rate, CASE WHEN graded > 0 THEN passed / graded END AS narrative_rate
FROM (SELECT submission_id, count(*) AS findings, count(*) FILTER (CASE WHEN source_kind = 'not_reached' THEN cell IS NOT NULL
    ELSE n % 11 <> 0 END) AS openable, count(*) FILTER (n % 4 <> 0) AS graded,
  count(*) FILTER (n % 4 <> 0 AND (submission_id, finding_id) NOT IN (SELECT (submission_id, finding_id) FROM (
    {NARRATIVE_PROBLEMS}))) AS passed
  FROM (SELECT *, CAST(finding_id[3:] AS INTEGER) AS n FROM v_findsrc) GROUP BY ALL)""")
def _(spark, sf):
    """Every eleventh finding cites rows past the end of its page or file; every fourth narrative isn't graded."""
    f = sourced(spark, sf)
    n = F.substring("finding_id", 3, 20).cast("int")
    off = f.withColumn("source_row_end", F.col("source_row_end") + F.when(n % 11 == 0, 4000).otherwise(0))
    wrong = rv.narrative_problems(a.narratives(f), f).select("submission_id", "finding_id").distinct().withColumn("bad", F.lit(True))
    graded = f.filter(n % 4 != 0).select("submission_id", "finding_id").join(wrong, ["submission_id", "finding_id"], "left")
    graded = graded.select("submission_id", "finding_id", F.col("bad").isNull().alias("passed"))
    return sc.rates(off, a.reservation_rows(spark, sf), a.inventory(spark, sf), graded)


@query("ag_24_sweep", EXPECTED + """
SELECT count(*) AS fixtures, count(*) FILTER (seen AND ok) AS passed, count(*) FILTER (seen AND NOT ok) AS failed,
  count(*) FILTER (NOT seen) AS unmeasured, count(*) > 0 AND bool_and(seen) AS complete
FROM (SELECT h.hotel_no % 5 <> 3 AS seen, coalesce(bool_and(s.outcome = 'compared' AND s.differs = ''), FALSE) AS ok
  FROM v_hotels h LEFT JOIN s ON s.fixture_id = h.submission_id GROUP BY h.submission_id, h.hotel_no)""")
def _(spark, sf):
    """Fixtures without a verdict are neither passed nor failed, and leave the sweep incomplete."""
    observed, expected = scores(spark, sf)
    fixtures = a.hotels(spark, sf).select(F.col("submission_id").alias("fixture_id"), "hotel_no")
    return sc.sweep(sc.outcomes(sc.score_findings(observed, expected), fixtures, fixtures.filter("hotel_no % 5 <> 3")))


@query("ag_24_outcomes", EXPECTED + """
SELECT h.submission_id AS fixture_id, count(s.fixture_id) AS checks,
  CASE WHEN coalesce(bool_and(s.outcome = 'compared' AND s.differs = ''), FALSE)
    AND count(s.fixture_id) > 0 THEN 'passed' ELSE 'failed' END AS outcome
FROM v_hotels h LEFT JOIN s ON s.fixture_id = h.submission_id GROUP BY ALL""")
def _(spark, sf):
    observed, expected = scores(spark, sf)
    fixtures = a.hotels(spark, sf).select(F.col("submission_id").alias("fixture_id"))
    return sc.outcomes(sc.score_findings(observed, expected), fixtures)


@query("wn_13_stop_at_blocking", """
SELECT submission_id, finding_id FROM v_find LEFT JOIN (
  SELECT submission_id, min(finding_id) AS stop FROM v_find WHERE severity = 'blocking' GROUP BY ALL)
  USING (submission_id) WHERE stop IS NULL OR finding_id = stop""")
def _(spark, sf):
    return sc.stop_at_first_blocking(stage(findings(spark, sf)), "finding_id").select(
        "submission_id", "finding_id")


PARTITIONS = """
WITH p AS (SELECT submission_id, nationality_iso2,
  list_distinct(list(status) FILTER (order_no % 2 = 1)) AS included,
  list_distinct(list(status) FILTER (order_no % 2 = 0)) AS excluded FROM v_res GROUP BY ALL),
q AS (SELECT submission_id, nationality_iso2,
  array_to_string(list_sort(list_intersect(coalesce(included, []), coalesce(excluded, []))), ',')
    AS overlap,
  array_to_string(list_sort([x FOR x IN ['CANCELLED', 'CHECKED_OUT', 'IN_HOUSE', 'NO_SHOW']
    IF NOT list_contains(coalesce(included, []), x)
      AND NOT list_contains(coalesce(excluded, []), x)]), ',') AS unruled FROM p)
"""


@query("ag_30_partition_checks", PARTITIONS + "SELECT * FROM q WHERE overlap <> '' OR unruled <> ''")
def _(spark, sf):
    out = sc.partition_problems(a.rule_partitions(spark, sf), v.STATUSES)
    return out.select("submission_id", "nationality_iso2",
                      F.concat_ws(",", "overlap").alias("overlap"),
                      F.concat_ws(",", "unruled").alias("unruled"))


@query("so_05_disjoint_and_total", PARTITIONS + """
SELECT submission_id, count(*) FILTER (overlap = '') AS disjoint,
  count(*) FILTER (unruled = '') AS total FROM q GROUP BY ALL""")
def _(spark, sf):
    rules = a.rule_partitions(spark, sf)
    every = F.array(*[F.lit(s) for s in v.STATUSES])
    return rules.groupBy("submission_id").agg(
        F.count_if(~F.arrays_overlap("included", "excluded")).alias("disjoint"),
        F.count_if(F.size(F.array_except(every, F.array_union("included", "excluded"))) == 0)
        .alias("total"))


@query("fl_06_first_eligible", """
SELECT reservation_id, rooms, status FROM v_res WHERE nights > 0 AND rooms = 1
  AND status = 'CHECKED_OUT' AND rate_code <> 'HOUSE' AND month(arrival_date) = 1
  AND month(departure_date) = 1 ORDER BY reservation_id LIMIT 1""")
def _(spark, sf):
    c = F.col
    ok = ((c("nights") > 0) & (c("rooms") == 1) & (c("status") == "CHECKED_OUT")
          & (c("rate_code") != "HOUSE") & (F.month("arrival_date") == 1)
          & (F.month("departure_date") == 1))
    return sc.first_eligible(a.reservations(spark, sf), ok, ["reservation_id"]).select(
        "reservation_id", "rooms", "status")


def _inventory_folder(spark, sf, lacking: bool = False) -> str:
    """One file per submission with its columns in one of three orders, some with a column more; where asked,
    every seventh hotel's file lacks a column."""
    path = shared_dir(spark)
    n = F.substring("submission_id", 3, 20).cast("int")
    inv = a.inventory(spark, sf).select(
        "submission_id", "hotel_id", "day", "rooms_total", "rooms_out_of_order",
        (F.col("rooms_total") - F.col("rooms_out_of_order")).alias("rooms_available"),
        F.lit("").alias("note"), n.alias("n"), F.col("submission_id").alias("filed_by"))
    plain = [c for c in inv.columns if c not in ("n", "filed_by")]
    lacks = (F.col("n") % 7 == 6) if lacking else F.lit(False)
    kinds = [(F.col("n") % 3 == 0, plain), (F.col("n") % 3 == 1, plain[::-1]),
             (F.col("n") % 3 == 2, [F.lit("a, b").alias("Floor"), *plain[2:], *[F.col(c).alias(c.upper()) for c in plain[:2]]])]
    if lacking:
        kinds = [(when & ~lacks, columns) for when, columns in kinds] + [(lacks, [c for c in plain if c != "rooms_total"])]
    for when, columns in kinds:
        # one folder per submission: a submission's inventory is a few thousand days
        spread(inv.filter(when), "submission_id").sortWithinPartitions("submission_id", "day").select(
            *columns, "filed_by").write.mode("append").partitionBy("filed_by").option("header", True).csv(path)
    return path


@query("src_01_inventory_files", """
SELECT submission_id, strftime(day, '%Y-%m-%d') AS day, rooms_total, rooms_out_of_order,
  CAST(row_number() OVER (PARTITION BY submission_id ORDER BY day) AS INTEGER) AS row_no FROM v_inv""")
def _(spark, sf):
    return readers.read_inventory(spark, _inventory_folder(spark, sf)).select(
        "submission_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "rooms_total",
        "rooms_out_of_order", "row_no")


@query("src_01_inventory_defects", """
WITH i AS (SELECT *, CAST(submission_id[3:] AS INTEGER) % 7 = 6 AS lacks FROM v_inv)
SELECT submission_id, count(*) FILTER (NOT lacks) AS days, CAST(bool_or(lacks) AS INTEGER) AS defects FROM i GROUP BY ALL""")
def _(spark, sf):
    """Files that lack a column give no rows and one defect; the others are read."""
    path = _inventory_folder(spark, sf, lacking=True)
    days = readers.read_inventory(spark, path).groupBy("submission_id").agg(F.count("*").alias("days"))
    found = readers.inventory_defects(spark, path).filter("missing = array('rooms_total') and size(repeated) = 0")
    found = found.select(F.regexp_extract("_path", "filed_by=([^/]+)/", 1).alias("submission_id"), F.lit(1).alias("defects"))
    return days.join(found, "submission_id", "full_outer").na.fill(0)


@query("src_02_reservation_files", """
SELECT reservation_id, strftime(arrival_date, '%Y-%m-%d') AS arrival, room_nights, status, rate_code
FROM v_res""")
def _(spark, sf):
    path = shared_dir(spark)
    cols = [c.split()[0] for c in readers.RESERVATION.split(", ")]
    a.reservations(spark, sf).select(*cols).write.option("header", True).csv(path)
    return readers.read_reservations(spark, path, "csv").select(
        "reservation_id", F.date_format("arrival_date", "yyyy-MM-dd").alias("arrival"),
        "room_nights", "status", "rate_code")


@query("src_03_truth_documents", """
SELECT submission_id AS hotel_id, metric_key, CAST(v AS DOUBLE) AS value FROM v_base
WHERE v IS NOT NULL""")
def _(spark, sf):
    path = shared_dir(spark)
    # a document holds one submission's keys: its periods times the metrics and nationalities
    docs = base(spark, sf).groupBy(F.col("submission_id").alias("hotel_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("metrics"))
    docs.select(F.to_json(F.struct("*")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return readers.read_truth(spark, path).select("hotel_id", "metric_key", num("value"))


@query("ag_27_quota_shortfalls", """
SELECT submission_id, 'nationalities' AS edge, count(DISTINCT nationality_iso2) AS have FROM v_res
GROUP BY ALL HAVING count(DISTINCT nationality_iso2) < 26""")
def _(spark, sf):
    return checks.edge_quotas(
        a.reservations(spark, sf), F.lit("1996-01-01").cast("date"),
        F.lit("2000-12-31").cast("date"), {"nationalities": 26}).filter("not met").select(
        "submission_id", "edge", "have")
