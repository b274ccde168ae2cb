"""Evidence, verdicts, marks, decisions and citations."""

from pyspark.sql import functions as F

from staycheck import values as v
from staycheck.catalog.metric_queries import staged_claims
from staycheck.catalog.reconcile_queries import findings, num
from staycheck.catalog.registry import query
from staycheck.operators import evidence as ev
from staycheck.operators import reconcile as r
from staycheck.operators import review as rv
from staycheck.operators import verdicts as vd
from staycheck.plans import adapters as a
from staycheck.plans.verify import verify
from staycheck.session import stage


def staged_findings(spark, sf):
    """Findings are read several times below, so they are written once."""
    return stage(findings(spark, sf))


def cited(spark, sf, f):
    return ev.evidence(f, a.reservation_rows(spark, sf), a.inventory(spark, sf))


def sourced(spark, sf):
    f = staged_findings(spark, sf)
    return stage(ev.with_primary_source(f, cited(spark, sf, f)))


@query("verify_submissions", """
SELECT submission_id, status, findings, definitional_items, hotel_errors, not_verifiable
FROM v_verdicts""")
def _(spark, sf):
    out = verify(a.reservations(spark, sf), a.inventory(spark, sf), staged_claims(spark, sf),
                 a.declared_periods(spark, sf))
    return out["verdicts"].select("submission_id", "status", "findings", "definitional_items",
                                  "hotel_errors", "not_verifiable")


@query("src_08_second_policy", """
SELECT submission_id, variance_class, severity, coalesce(explaining, '') AS explaining, count(*) AS findings
FROM v_ofind GROUP BY ALL""")
def _(spark, sf):
    """The same claims under a policy document with other rates, alternatives, band and severities."""
    out = verify(a.reservations(spark, sf), a.inventory(spark, sf), staged_claims(spark, sf),
                 a.declared_periods(spark, sf), policy=a.other_policy())
    return out["findings"].groupBy("submission_id", "variance_class", "severity", F.coalesce(
        "explaining_permutation", F.lit("")).alias("explaining")).agg(F.count("*").alias("findings"))


@query("ag_17_evidence_ranges", """
SELECT submission_id, metric_key, source_kind, file, CAST(coalesce(page, 0) AS INTEGER) AS page,
  row_start, row_end FROM v_evidence""")
def _(spark, sf):
    return cited(spark, sf, staged_findings(spark, sf)).na.fill(0, ["page"])


@query("wn_02_collapse_ranges", """
SELECT submission_id, file, page, CAST(min(row_no) AS INTEGER) AS row_start,
  CAST(max(row_no) AS INTEGER) AS row_end FROM (
  SELECT submission_id, file, page, row_no, row_no - row_number() OVER (
    PARTITION BY submission_id, file, page ORDER BY row_no) AS g
  FROM v_rows WHERE status IN ('CHECKED_OUT', 'IN_HOUSE') AND rate_code <> 'HOUSE')
GROUP BY submission_id, file, page, g""")
def _(spark, sf):
    from staycheck.operators.metrics import qualifying
    from staycheck.sources.rulesets import rulesets
    rows = qualifying(a.reservation_rows(spark, sf), rulesets()[0])
    return ev.collapse_ranges(rows, ["submission_id", "file", "page"], "row_no", "row_no")


@query("prj_20_citations", """
SELECT submission_id, finding_id, CASE source_kind
  WHEN 'pdf' THEN source_file || ' p.' || source_page || ' ' || rows
  WHEN 'inventory' THEN source_file || ' ' || rows
  ELSE 'not reached (no rows support a value for this key)' END AS source,
  CASE WHEN cell IS NULL THEN '' ELSE sheet || '!' || cell END AS excel
FROM (SELECT *, CASE WHEN source_row_start = source_row_end THEN 'row ' || source_row_start
  ELSE 'rows ' || source_row_start || '-' || source_row_end END AS rows FROM v_findsrc)""")
def _(spark, sf):
    return sourced(spark, sf).select(
        "submission_id", "finding_id", ev.source_citation().alias("source"),
        ev.excel_citation().alias("excel"))


@query("prj_19_finding_invariants", """
SELECT submission_id, finding_id, 'correction_only_on_v1' AS problems FROM v_findsrc
WHERE variance_class = 'V5' AND CAST(finding_id[3:6] AS INTEGER) % 10 = 0 AND sheet IS NULL
UNION ALL
SELECT submission_id, finding_id, 'v2_goes_to_policy_owner' FROM v_findsrc
WHERE variance_class = 'V2' AND CAST(finding_id[3:6] AS INTEGER) % 4 = 0""")
def _(spark, sf):
    n = F.substring("finding_id", 3, 4).cast("int")
    broken = sourced(spark, sf).withColumns({
        "proposed_correction": F.when(
            (F.col("variance_class") == "V5") & (n % 10 == 0) & F.col("sheet").isNull(), 1
        ).otherwise(F.col("proposed_correction")),
        "escalates_to": F.when((F.col("variance_class") == "V2") & (n % 4 == 0), "hotel")
        .otherwise(F.col("escalates_to")),
    })
    return r.finding_problems(broken).select(
        "submission_id", "finding_id", F.concat_ws(",", "problems").alias("problems"))


@query("ag_18_verdict_summary", "SELECT * FROM v_summary")
def _(spark, sf):
    return _summary(spark, sf)


def _summary(spark, sf):
    out = verify(a.reservations(spark, sf), a.inventory(spark, sf), staged_claims(spark, sf),
                 a.declared_periods(spark, sf), reviews=a.reviews(spark, sf))
    return out["verdicts"].drop("status", "rejection_reason")


@query("ag_19_status", "SELECT submission_id, status FROM v_verdicts")
def _(spark, sf):
    out = verify(a.reservations(spark, sf), a.inventory(spark, sf), staged_claims(spark, sf),
                 a.declared_periods(spark, sf))
    return out["verdicts"].select("submission_id", "status")


@query("ag_21_summary_integrity", """
SELECT submission_id, 'hotel_errors' AS differs FROM v_summary
WHERE CAST(submission_id[3:] AS INTEGER) % 3 = 0""")
def _(spark, sf):
    s = stage(_summary(spark, sf))
    n = F.substring("submission_id", 3, 20).cast("int")
    edited = s.withColumn("hotel_errors", F.col("hotel_errors") + F.when(n % 3 == 0, 1).otherwise(0))
    return vd.summary_mismatches(edited, s).select(
        "submission_id", F.concat_ws(",", "differs").alias("differs"))


@query("wn_12_cell_marks", """
SELECT submission_id, sheet, cell, fill, finding_id FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id, sheet, cell
    ORDER BY u DESC, finding_id DESC) AS rn FROM (
    SELECT submission_id, sheet, cell, -1 AS u, '' AS finding_id, 'verified' AS fill FROM v_claims
    UNION ALL SELECT submission_id, sheet, cell,
      CASE WHEN severity = 'blocking' THEN 3 WHEN variance_class = 'V2' THEN 1 ELSE 2 END,
      finding_id, CASE WHEN severity = 'blocking' THEN 'blocking'
        WHEN variance_class = 'V2' THEN 'definitional' ELSE 'material' END
    FROM v_find WHERE cell IS NOT NULL)) WHERE rn = 1""")
def _(spark, sf):
    c = staged_claims(spark, sf)
    sheets = c.select("submission_id", "sheet").distinct()
    return vd.cell_marks(c, findings(spark, sf), sheets)


@query("wn_12_unplaced", """
SELECT submission_id, finding_id, 'no cell' AS reason FROM v_find WHERE cell IS NULL
UNION ALL SELECT submission_id, finding_id, 'unknown sheet' FROM v_find
WHERE sheet = 'Nationality' AND CAST(submission_id[3:] AS INTEGER) % 2 = 0""")
def _(spark, sf):
    c = staged_claims(spark, sf).filter(~((F.col("sheet") == "Nationality") & (
        a.hotel_no() % 2 == 0)))
    return vd.unplaced(findings(spark, sf), c)


@query("snk_02_verdict_documents", """
SELECT v.submission_id, v.status, v.findings AS finding_rows, v.definitional_items AS policy_rows,
  coalesce(min(f.finding_id) FILTER (f.variance_class <> 'V2'), '') AS first_finding
FROM v_verdicts v LEFT JOIN v_find f USING (submission_id) GROUP BY ALL""")
def _(spark, sf):
    from staycheck.session import shared_dir
    from staycheck.sources.writers import write_verdicts
    out = verify(a.reservations(spark, sf), a.inventory(spark, sf), staged_claims(spark, sf),
                 a.declared_periods(spark, sf))
    path = shared_dir(spark)
    write_verdicts(out["verdicts"], out["findings"], path)
    docs = spark.read.schema(
        "submission_id string, status string, finding_list array<struct<finding_id:string>>, "
        "definitional_list array<struct<finding_id:string>>").json(path)
    none = F.array().cast("array<struct<finding_id:string>>")
    return docs.select(
        "submission_id", "status",
        F.size(F.coalesce("finding_list", none)).cast("bigint").alias("finding_rows"),
        F.size(F.coalesce("definitional_list", none)).cast("bigint").alias("policy_rows"),
        F.coalesce(F.get("finding_list", F.lit(0))["finding_id"], F.lit("")).alias("first_finding"))


@query("jn_15_unknown_reviews", """
SELECT submission_id, finding_id, seq FROM v_reviews
WHERE (submission_id, finding_id) NOT IN (SELECT (submission_id, finding_id) FROM v_find)""")
def _(spark, sf):
    return rv.unknown_findings(a.reviews(spark, sf), findings(spark, sf)).select(
        "submission_id", "finding_id", "seq")


@query("jn_15_undecided", """
SELECT submission_id, finding_id FROM v_find
WHERE (submission_id, finding_id) NOT IN (SELECT (submission_id, finding_id) FROM v_reviews)""")
def _(spark, sf):
    return rv.undecided(findings(spark, sf), a.reviews(spark, sf)).select(
        "submission_id", "finding_id")


@query("wn_06_standing_decisions", """
SELECT submission_id, finding_id, arg_max(decision, seq) AS decision,
  arg_max(reviewer, seq) AS reviewer, max(seq) AS seq, count(*) - 1 AS superseded
FROM v_reviews GROUP BY ALL""")
def _(spark, sf):
    return rv.standing_decisions(a.reviews(spark, sf)).drop("amended_value")


@query("wn_06_superseded", """
SELECT submission_id, finding_id, seq, decision FROM v_reviews QUALIFY
  seq < max(seq) OVER (PARTITION BY submission_id, finding_id)""")
def _(spark, sf):
    return rv.superseded(a.reviews(spark, sf)).select(
        "submission_id", "finding_id", "seq", "decision")


@query("prj_29_review_problems", """
SELECT * FROM (SELECT r.seq, array_to_string([x FOR x IN [
  CASE WHEN trim(reviewer) = '' THEN 'no_name' END,
  CASE WHEN length(trim(reviewer)) > 120 OR contains(trim(reviewer), chr(10)) THEN 'not_a_name' END,
  CASE WHEN f.finding_id IS NULL THEN 'unknown_finding' END,
  CASE WHEN decision = 'amend' AND amended_value IS NULL THEN 'amend_needs_value' END,
  CASE WHEN decision <> 'amend' AND amended_value IS NOT NULL THEN 'value_without_amend' END,
  CASE WHEN decision = 'amend' AND amended_value = 'NaN' THEN 'not_a_figure' END,
  CASE WHEN decision = 'amend' AND f.variance_class <> 'V1' THEN 'amend_only_v1' END]
  IF x IS NOT NULL], ',') AS problems
FROM v_reviews r LEFT JOIN v_find f USING (submission_id, finding_id)) WHERE problems <> ''""")
def _(spark, sf):
    return rv.review_problems(a.reviews(spark, sf), findings(spark, sf)).select(
        "seq", F.concat_ws(",", "problems").alias("problems"))


@query("jn_21_citation_problems", """
WITH c AS (SELECT *, CAST(finding_id[3:6] AS INTEGER) AS n FROM v_findsrc)
SELECT submission_id, finding_id, 'no such ' || source_kind AS problem FROM c
WHERE source_kind <> 'not_reached' AND n % 5 = 0 AND (submission_id, source_kind, source_file,
  coalesce(source_page, 0), source_row_start, source_row_end + 1) NOT IN (
  SELECT (submission_id, source_kind, source_file, coalesce(source_page, 0), source_row_start,
    source_row_end) FROM v_findsrc WHERE source_kind <> 'not_reached')
UNION ALL SELECT submission_id, finding_id, 'no such excel' FROM c
  WHERE cell IS NOT NULL AND n % 7 = 0
UNION ALL SELECT submission_id, finding_id, 'no such clause' FROM c WHERE n % 11 = 0
UNION ALL SELECT submission_id, finding_id, 'other policy version' FROM c
  WHERE n % 13 = 0 AND n % 11 <> 0""")
def _(spark, sf):
    f = sourced(spark, sf)
    clauses = f.select("clause").distinct()
    return rv.citation_problems(a.citations(f), f, clauses, v.POLICY_VERSION).select(
        "submission_id", "finding_id", "problem")


NARRATIVE_PROBLEMS = """
SELECT * FROM (SELECT submission_id, finding_id, array_to_string([x FOR x IN [
  CASE WHEN echoed_id <> finding_id THEN 'misrouted' END,
  CASE WHEN cites IS NOT NULL AND NOT coalesce(cites = explaining OR list_contains(also, cites),
    FALSE) THEN 'unassigned_cause' END,
  CASE WHEN length(sentence) > 600 THEN 'too_long' END,
  CASE WHEN n % 29 = 0 THEN 'ungrounded' END, CASE WHEN n % 31 = 0 THEN 'leaks a number' END,
  CASE WHEN n % 37 = 0 THEN 'names an unassigned cause' END,
  CASE WHEN n % 41 = 0 THEN 'reads as an accusation' END] IF x IS NOT NULL], ',') AS problems
FROM v_narr) WHERE problems <> ''"""


@query("prj_31_narratives", NARRATIVE_PROBLEMS)
def _(spark, sf):
    f = staged_findings(spark, sf)
    return rv.narrative_problems(a.narratives(f), f).select(
        "submission_id", "finding_id", F.concat_ws(",", "problems").alias("problems"))


@query("jn_28_evidence_rows", """
SELECT DISTINCT submission_id, metric_key, file, page, row_no FROM v_cited WHERE source_kind = 'pdf'""")
def _(spark, sf):
    rows = a.reservation_rows(spark, sf)
    return ev.evidence_rows(cited(spark, sf, staged_findings(spark, sf)), rows).select(
        "submission_id", "metric_key", "file", "page", "row_no")


@query("jn_28_absent_rows", """
WITH last AS (SELECT submission_id, file, page, max(row_no) AS n FROM v_rows GROUP BY ALL)
SELECT e.submission_id, e.metric_key, e.file, e.page, CAST(n + 1 AS INTEGER) AS row_start,
  CAST(e.row_end + 2 AS INTEGER) AS row_end
FROM v_findsrc f JOIN v_evidence e USING (submission_id, metric_key)
JOIN last l ON l.submission_id = e.submission_id AND l.file = e.file AND l.page = e.page
WHERE e.source_kind = 'pdf' AND e.file = f.source_file AND e.page = f.source_page
  AND e.row_start = f.source_row_start AND e.row_end + 2 > n""")
def _(spark, sf):
    f = sourced(spark, sf).filter("source_kind = 'pdf'").select(
        "submission_id", "metric_key", "source_kind", F.col("source_file").alias("file"),
        F.col("source_page").alias("page"), F.col("source_row_start").alias("row_start"),
        (F.col("source_row_end") + 2).alias("row_end"))
    return ev.absent_rows(f, a.reservation_rows(spark, sf))


@query("jn_29_cell_neighbourhood", """
WITH f AS (SELECT c.submission_id, c.metric_key, c.sheet, c.row, c.col FROM v_claims c
  JOIN v_find USING (submission_id, metric_key)),
near AS (SELECT submission_id, metric_key, sheet, row, unnest(generate_series(col - 3, col + 3)) AS col
  FROM (SELECT submission_id, metric_key, sheet, unnest(generate_series(row - 3, row + 3)) AS row, col FROM f))
SELECT n.submission_id, n.metric_key, c.cell AS near, CAST(c.value AS DOUBLE) AS value
FROM near n JOIN v_claims c USING (submission_id, sheet, row, col)""")
def _(spark, sf):
    cells = staged_claims(spark, sf).select(
        "submission_id", "sheet", "row", "col", F.col("cell").alias("near"), num("value"))
    return ev.cell_neighbourhood(findings(spark, sf), cells, v.CELL_RADIUS).select(
        "submission_id", "metric_key", "near", "value")
