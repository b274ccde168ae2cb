"""Claims against computed values: pairing, explanations, the ladder and findings."""

from pyspark.sql import functions as F

from staycheck.catalog.metric_queries import staged_claims, staged_values
from staycheck.catalog.registry import query
from staycheck.operators import reconcile as r
from staycheck.plans import adapters as a
from staycheck.session import stage


def pairs(spark, sf):
    metrics = staged_values(spark, sf)
    return r.pair(a.claims(metrics), metrics)


def classified(spark, sf):
    return r.classify(r.with_explanations(pairs(spark, sf)))


def all_findings(spark, sf):
    return r.to_findings(classified(spark, sf))


def findings(spark, sf):
    # numbering reads them twice
    return r.with_finding_ids(stage(r.raised(all_findings(spark, sf))))


def num(name):
    return F.col(name).cast("double").alias(name)


@query("prj_06_render_key", """
SELECT submission_id, metric_key, metric, period, dimension, value_key FROM v_claims""")
def _(spark, sf):
    from staycheck.functions.keys import parse_key
    c = staged_claims(spark, sf).select("submission_id", "metric_key")
    return c.withColumns(parse_key(F.col("metric_key")))


@query("jn_05_pair", """
SELECT submission_id, metric_key, pairing, CAST(claimed AS DOUBLE) AS claimed,
  CAST(computed AS DOUBLE) AS computed FROM v_pairs""")
def _(spark, sf):
    return pairs(spark, sf).select(
        "submission_id", "metric_key", "pairing", num("claimed"), num("computed"))


@query("so_01_key_union", """
SELECT submission_id, metric, count(*) AS keys FROM v_pairs GROUP BY ALL""")
def _(spark, sf):
    return pairs(spark, sf).groupBy("submission_id", "metric").agg(F.count("*").alias("keys"))


@query("jn_06_explanations", """
SELECT submission_id, metric_key, ruleset_id FROM v_explained""")
def _(spark, sf):
    return r.with_explanations(pairs(spark, sf)).select(
        "submission_id", "metric_key", F.explode("explained_by").alias("ruleset_id"))


@query("wn_03_first_explanation", """
SELECT submission_id, metric_key, first(ruleset_id ORDER BY ord) AS named,
  array_to_string(list(ruleset_id ORDER BY ord)[2:], ',') AS others
FROM v_explained GROUP BY ALL""")
def _(spark, sf):
    df = r.with_explanations(pairs(spark, sf)).filter(F.size("explained_by") > 0)
    return df.select("submission_id", "metric_key", F.get("explained_by", F.lit(0)).alias("named"),
                     F.concat_ws(",", F.slice("explained_by", F.lit(2), F.size("explained_by"))).alias("others"))


@query("prj_15_tolerance", """
SELECT submission_id, metric_key, abs(claimed - computed) <=
  CASE WHEN metric = 'occupancy_pct' THEN 0.10 ELSE 0 END AS inside
FROM v_pairs WHERE pairing = 'matched'""")
def _(spark, sf):
    from staycheck.functions.keys import within_tolerance
    return pairs(spark, sf).filter("pairing = 'matched'").select(
        "submission_id", "metric_key",
        within_tolerance(F.col("claimed") - F.col("computed"), F.col("metric")).alias("inside"))


@query("prj_16_classify", """
SELECT submission_id, metric_key, variance_class FROM v_class WHERE variance_class IS NOT NULL""")
def _(spark, sf):
    return classified(spark, sf).filter("variance_class is not null").select(
        "submission_id", "metric_key", "variance_class")


@query("prj_17_severity", """
SELECT submission_id, variance_class, severity, escalates_to, count(*) AS findings
FROM v_allfind GROUP BY ALL""")
def _(spark, sf):
    return all_findings(spark, sf).groupBy(
        "submission_id", "variance_class", "severity", "escalates_to").agg(
        F.count("*").alias("findings"))


@query("prj_18_findings", """
SELECT submission_id, metric_key, variance_class, CAST(claimed AS DOUBLE) AS claimed,
  CAST(computed AS DOUBLE) AS computed, CAST(difference AS DOUBLE) AS difference,
  CAST(correction AS DOUBLE) AS proposed_correction, explaining AS explaining_permutation,
  array_to_string(also, ',') AS also_explained_by, sheet, cell, clause FROM v_allfind""")
def _(spark, sf):
    return all_findings(spark, sf).select(
        "submission_id", "metric_key", "variance_class", num("claimed"), num("computed"),
        num("difference"), num("proposed_correction"), "explaining_permutation",
        F.concat_ws(",", "also_explained_by").alias("also_explained_by"), "sheet", "cell", "clause")


@query("prj_28_hotel_errors", """
SELECT submission_id, metric, count(*) AS hotel_errors FROM v_allfind
WHERE variance_class IN ('V1','V5') GROUP BY ALL""")
def _(spark, sf):
    return all_findings(spark, sf).filter(F.col("variance_class").isin("V1", "V5")).groupBy(
        "submission_id", "metric").agg(F.count("*").alias("hotel_errors"))


@query("wn_01_finding_ids", """
SELECT submission_id, finding_id, metric_key, variance_class FROM v_find""")
def _(spark, sf):
    return findings(spark, sf).select(
        "submission_id", "finding_id", "metric_key", "variance_class")


@query("fl_01_ordered_findings", """
SELECT submission_id, metric_key, clause FROM v_allfind ORDER BY submission_id, metric_key""")
def _(spark, sf):
    return all_findings(spark, sf).select("submission_id", "metric_key", "clause").orderBy(
        "submission_id", "metric_key")


@query("so_02_finding_lists", """
SELECT submission_id, CASE WHEN variance_class = 'V2' THEN 'definitional'
  WHEN severity = 'informational' THEN 'informational' ELSE 'raised' END AS list,
  count(*) AS findings FROM v_allfind GROUP BY ALL""")
def _(spark, sf):
    kind = F.when(F.col("variance_class") == "V2", "definitional").when(
        F.col("severity") == "informational", "informational").otherwise("raised")
    return all_findings(spark, sf).groupBy("submission_id", kind.alias("list")).agg(
        F.count("*").alias("findings"))


@query("jn_05_refused_claims", """
SELECT submission_id, metric_key, clause, '2 claims' AS detail, kept FROM (
  SELECT submission_id, metric_key, 'D-QUAL-07' AS clause FROM v_claims WHERE metric = 'room_nights_sold')
JOIN (SELECT submission_id, count(*) FILTER (metric <> 'room_nights_sold') AS kept FROM v_claims GROUP BY ALL)
  USING (submission_id)""")
def _(spark, sf):
    c = staged_claims(spark, sf)
    kept, refused = r.accepted_claims(c.unionByName(c.filter("metric = 'room_nights_sold'")))
    left = kept.groupBy("submission_id").agg(F.count("*").alias("kept"))
    return refused.join(left, "submission_id").select("submission_id", "metric_key", "clause", "detail", "kept")


@query("ag_22_duplicate_claims", """
WITH twice AS (SELECT * FROM v_claims UNION ALL
  SELECT * REPLACE (value + 1 AS value) FROM v_claims WHERE metric = 'room_nights_sold')
SELECT submission_id, metric_key, count(*) AS claims, CAST(min(value) AS DOUBLE) AS lowest,
  CAST(max(value) AS DOUBLE) AS highest FROM twice GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    c = staged_claims(spark, sf)
    again = c.filter("metric = 'room_nights_sold'").withColumn(
        "value", (F.col("value") + 1).cast("decimal(38,10)"))
    return r.duplicate_claims(c.unionByName(again), ["submission_id", "metric_key"]).select(
        "submission_id", "metric_key", "claims", num("lowest"), num("highest"))
