"""Workbook reading and its self-checks."""

from pyspark.sql import functions as F

from staycheck.catalog.metric_queries import staged_claims
from staycheck.catalog.reconcile_queries import num
from staycheck.catalog.registry import query
from staycheck.functions import cells as cl
from staycheck.functions import periods as pd
from staycheck.functions.text import transpose_digits
from staycheck.operators import labels
from staycheck.operators import workbook as wb
from staycheck.plans import adapters as a
from staycheck.session import stage


def claims(spark, sf):
    return staged_claims(spark, sf)


def cells(spark, sf):
    return stage(a.workbook_cells(stage(claims(spark, sf))))


def resolved(spark, sf, c):
    return wb.resolve_blocks(a.mapping_blocks(spark, sf), wb.sheet_extents(c))


def reading(spark, sf):
    c = cells(spark, sf)
    index = labels.alias_index(labels.committed_labels(spark)).filter("kind = 'country'")
    return wb.read_claims(c, resolved(spark, sf, c), index)


@query("jn_10_read_claims", """
SELECT submission_id, metric_key, CAST(value AS DOUBLE) AS value, sheet, cell FROM v_claims
WHERE (row + col) % 31 <> 0 AND coalesce(value_key, '') <> 'XK'""")
def _(spark, sf):
    return reading(spark, sf).filter("kind = 'claim'").select(
        "submission_id", "metric_key", num("value"), "sheet", "cell")


@query("jn_10_read_defects", """
SELECT submission_id, sheet, cell, 'uncached formula' AS problem FROM v_claims
WHERE (row + col) % 31 = 0
UNION ALL SELECT DISTINCT submission_id, sheet, 'A' || row, 'unmappable_label' FROM v_claims
WHERE value_key = 'XK'""")
def _(spark, sf):
    return reading(spark, sf).filter("kind = 'defect'").select(
        "submission_id", "sheet", "cell", "problem")


@query("prj_11_cell_values", """
SELECT submission_id, sheet, row, col, CAST(CASE WHEN text LIKE '=%' THEN NULL ELSE value END
  AS DOUBLE) AS value, CASE WHEN text LIKE '=%' THEN 'uncached formula' ELSE '' END AS problem
FROM (SELECT c.submission_id, c.sheet, c.row, c.col, c.value, w.text FROM v_claims c
  JOIN v_wcells w ON w.role = 'figure' AND w.submission_id = c.submission_id
    AND w.sheet = c.sheet AND w.row = c.row AND w.col = c.col)
UNION ALL SELECT submission_id, sheet, row, col, CAST(number AS DOUBLE), '' FROM v_wcells
  WHERE role IN ('total', 'extra') AND number IS NOT NULL
UNION ALL SELECT submission_id, sheet, row, col, CASE WHEN text LIKE 'AED%' THEN 612.4
    WHEN length(text) = 4 AND role = 'period' THEN CAST(text AS DOUBLE) END,
  CASE WHEN text LIKE 'AED%' OR (length(text) = 4 AND role = 'period') THEN ''
    ELSE 'not a figure' END
FROM v_wcells WHERE role IN ('period', 'dimension') OR (role = 'extra' AND text IS NOT NULL)""")
def _(spark, sf):
    v = cl.cell_value(F.col("text"), F.col("number"), F.col("number_format"), F.col("value_type"))
    return cells(spark, sf).withColumn("v", v).select(
        "submission_id", "sheet", "row", "col", F.col("v.value").cast("double").alias("value"),
        F.coalesce("v.problem", F.lit("")).alias("problem"))


@query("prj_12_looks_numeric", """
SELECT submission_id, sheet, count(*) FILTER (figure) AS figures,
  count(*) FILTER (NOT figure) AS labels FROM v_looks GROUP BY ALL""")
def _(spark, sf):
    figure = F.col("number").isNotNull() | cl.looks_numeric(F.col("text"))
    return cells(spark, sf).groupBy("submission_id", "sheet").agg(
        F.count_if(figure).alias("figures"), F.count_if(~figure).alias("labels"))


@query("prj_13_masked_cells", """
WITH s AS (SELECT *, CASE WHEN figure THEN '<value>' WHEN text LIKE '=%' THEN '<formula>'
    ELSE text END AS shown FROM v_looks),
c AS (SELECT *, shown IN ('<value>', '<formula>') AS token,
  shown IN ('<value>', '<formula>') AND row > 8 AS low FROM s)
SELECT submission_id, sheet, row, col, shown, low OR (NOT token AND row_number() OVER (
  PARTITION BY submission_id, sheet, low ORDER BY row, col) > 200) AS omitted FROM c""")
def _(spark, sf):
    from staycheck import values
    return wb.peek(cells(spark, sf), values.VALUE_PREVIEW_ROWS, values.MAX_LABELS).select(
        "submission_id", "sheet", "row", "col", "shown", "omitted")


@query("jn_09_metric_scope", """
SELECT m.metric, CASE WHEN m.metric IN ('mystery') THEN 'unknown'
  WHEN m.metric IN ('average_daily_rate', 'revenue') THEN 'out_of_scope' ELSE 'in_scope' END AS scope,
  count(*) AS blocks
FROM v_hotels, (VALUES ('room_nights_sold', 1, 0), ('room_nights_available', 1, 0),
  ('occupancy_pct', 1, 0), ('guests_by_nationality', 1, 0), ('average_daily_rate', 1, 0),
  ('mystery', 2, 1), ('occupancy_pct', 3, 0), ('occupancy_pct', 4, 0), ('revenue', 5, 0),
  ('guests_by_nationality', 2, 0), ('occupancy_pct', 3, 1)) m(metric, every, rest)
WHERE hotel_no % m.every = m.rest GROUP BY ALL""")
def _(spark, sf):
    return a.mapping_blocks(spark, sf).groupBy(
        "metric", wb.metric_scope(F.col("metric")).alias("scope")).agg(
        F.count("*").alias("blocks"))


@query("prj_22_resolve_blocks", """
WITH claimed AS (SELECT DISTINCT submission_id FROM v_claims),
x AS (SELECT submission_id, sheet, max(row) AS mr, max(col) AS mc FROM v_wcells GROUP BY ALL),
b AS (SELECT h.submission_id, m.* FROM v_hotels h, (VALUES
  ('1', 1, 0, 'Occupancy', 211, NULL), ('2', 1, 0, 'Occupancy', 211, NULL),
  ('3', 1, 0, 'Occupancy', 211, NULL), ('4', 1, 0, 'Nationality', 31, NULL),
  ('5', 1, 0, 'Rate & Revenue', 0, 'out_of_scope'), ('6', 2, 1, 'Occupancy', 0, 'unknown metric'),
  ('7', 3, 0, 'Missing', 0, NULL), ('8', 4, 0, 'Occupancy', 0, 'values must be one column'),
  ('9', 5, 0, 'Occupancy', 0, 'out_of_scope'), ('10', 2, 0, 'Nationality', 0, 'dimension required'),
  ('11', 3, 1, 'Occupancy', 999, 'value_range leaves the used area'))
  m(block_id, every, rest, sheet, needs_row, outcome) WHERE h.hotel_no % m.every = m.rest)
SELECT b.submission_id, block_id, CASE WHEN x.sheet IS NULL THEN 'needs_human_mapping'
    WHEN outcome = 'out_of_scope' THEN outcome WHEN outcome IS NOT NULL THEN 'needs_human_mapping'
    WHEN block_id IN ('1','2','3') AND mr < 211 THEN 'needs_human_mapping'
    WHEN block_id = '4' AND mc < 208 THEN 'needs_human_mapping'
    ELSE 'in_scope' END AS disposition,
  CASE WHEN x.sheet IS NULL THEN 'no such sheet' WHEN outcome = 'out_of_scope' THEN ''
    WHEN outcome IS NOT NULL THEN outcome
    WHEN block_id IN ('1','2','3') AND mr < 211 THEN 'value_range leaves the used area'
    WHEN block_id = '4' AND mc < 208 THEN 'value_range leaves the used area' ELSE '' END AS problem
FROM b LEFT JOIN x ON x.submission_id = b.submission_id AND x.sheet = b.sheet""")
def _(spark, sf):
    return resolved(spark, sf, cells(spark, sf)).select(
        "submission_id", "block_id", "disposition",
        F.coalesce("problem", F.lit("")).alias("problem"))


@query("jn_11_uncovered_figures", """
SELECT submission_id, sheet, row, col FROM v_looks WHERE figure AND (role = 'period'
  OR (role = 'extra' AND text IS NULL))""")
def _(spark, sf):
    c = cells(spark, sf)
    return wb.uncovered_figures(c, resolved(spark, sf, c)).select(
        "submission_id", "sheet", "row", "col")


@query("jn_12_unmentioned_sheets", """
SELECT DISTINCT submission_id, 'Notes' AS sheet FROM v_claims""")
def _(spark, sf):
    c = cells(spark, sf)
    cover = a.hotels(spark, sf).select("submission_id", F.lit("Summary").alias("sheet"))
    return wb.unmentioned_sheets(c, a.mapping_blocks(spark, sf), cover)


@query("jn_16_rollups", """
WITH m AS (SELECT c.*, q.quarter, q.year FROM v_claims c JOIN v_months q ON q.month = c.period
  WHERE metric <> 'occupancy_pct'),
s AS (SELECT submission_id, metric, value_key, quarter AS period, sum(value) AS implied,
    count(*) AS months FROM m GROUP BY ALL
  UNION ALL SELECT submission_id, metric, value_key, year, sum(value), count(*) FROM m GROUP BY ALL)
SELECT c.submission_id, c.metric_key, CAST(c.value AS DOUBLE) AS value,
  CAST(s.implied AS DOUBLE) AS implied, s.months
FROM v_claims c JOIN s ON s.submission_id = c.submission_id AND s.metric = c.metric
  AND s.period = c.period AND s.value_key IS NOT DISTINCT FROM c.value_key
WHERE s.implied <> c.value""")
def _(spark, sf):
    return wb.rollup_mismatches(claims(spark, sf)).select(
        "submission_id", "metric_key", num("value"), num("implied"), "months")


@query("jn_17_occupancy_consistency", """
SELECT submission_id, period, CAST(stated AS DOUBLE) AS stated, CAST(implied AS DOUBLE) AS implied
FROM (SELECT *, CAST((20000 * CAST(sold AS HUGEINT) + CAST(available AS HUGEINT))
    // (2 * CAST(available AS HUGEINT)) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS implied FROM (
  SELECT submission_id, period, max(value) FILTER (metric = 'occupancy_pct') AS stated,
    max(value) FILTER (metric = 'room_nights_sold') AS sold,
    max(value) FILTER (metric = 'room_nights_available') AS available
  FROM v_claims WHERE dimension IS NULL GROUP BY ALL)
  WHERE stated IS NOT NULL AND sold IS NOT NULL AND available <> 0)
WHERE abs(stated - implied) > 0.10""")
def _(spark, sf):
    return wb.occupancy_mismatches(claims(spark, sf)).select(
        "submission_id", "period", num("stated"), num("implied"))


@query("jn_18_dimension_totals", """
SELECT t.submission_id, t.period, CAST(t.total AS DOUBLE) AS stated,
  CAST(c.implied AS DOUBLE) AS implied, c.components
FROM (SELECT submission_id, period, sum(value) + CASE WHEN min(col - 2) % 9 = 0 THEN 3 ELSE 0 END
    AS total FROM v_claims WHERE value_key IS NOT NULL GROUP BY ALL) t
JOIN (SELECT submission_id, period, sum(value) AS implied, count(*) AS components FROM v_claims
  WHERE value_key IS NOT NULL AND value_key <> 'XK' AND (row + col) % 31 <> 0 GROUP BY ALL) c
  ON c.submission_id = t.submission_id AND c.period = t.period
WHERE t.total <> c.implied""")
def _(spark, sf):
    r = stage(reading(spark, sf))
    return wb.dimension_total_mismatches(
        r.filter("kind = 'claim'"), r.filter("kind = 'total'")).select(
        "submission_id", "period", F.col("value").cast("double").alias("stated"), num("implied"),
        "components")


@query("ag_31_claim_grid", """
WITH c AS (SELECT submission_id, value_key, value, coalesce(m.quarter, period) AS quarter,
    CASE WHEN m.month IS NULL THEN 4 ELSE (month(m.m0) - 1) % 3 + 1 END AS slot
  FROM v_claims v LEFT JOIN v_months m ON m.month = v.period
  WHERE value_key IS NOT NULL AND length(period) = 7)
SELECT submission_id, quarter, label, CAST(sum(value) FILTER (slot = 1) AS DOUBLE) AS m1,
  CAST(sum(value) FILTER (slot = 2) AS DOUBLE) AS m2,
  CAST(sum(value) FILTER (slot = 3) AS DOUBLE) AS m3,
  CAST(sum(value) FILTER (slot = 4) AS DOUBLE) AS total
FROM (SELECT *, value_key AS label FROM c UNION ALL SELECT *, 'Total' FROM c) GROUP BY ALL""")
def _(spark, sf):
    grid = wb.claim_grid(claims(spark, sf))
    return grid.select("submission_id", "quarter", "label",
                       *[num(c) for c in ("m1", "m2", "m3", "total")])


@query("prj_21_a1_rectangles", """
SELECT submission_id, cell, row AS max_row, col AS max_col, 'A1:' || cell AS rendered FROM v_claims""")
def _(spark, sf):
    c = claims(spark, sf).select("submission_id", "cell")
    rect = cl.parse_rect(F.concat(F.lit(" a1:"), F.lower("cell")))
    return c.withColumn("r", rect).select(
        "submission_id", "cell", "r.max_row", "r.max_col",
        cl.render_rect(F.col("r")).alias("rendered"))


@query("prj_10_period_labels", """
SELECT c.submission_id, c.sheet, c.period AS parsed, count(*) AS cells FROM (
  SELECT DISTINCT submission_id, sheet, period FROM v_claims) c GROUP BY ALL""")
def _(spark, sf):
    c = cells(spark, sf).filter("(sheet = 'Occupancy' and col = 1) or (sheet = 'Nationality' "
                                "and row = 4)")
    return c.groupBy("submission_id", "sheet", pd.parse_period_label(F.col("text")).alias("parsed")
                     ).agg(F.count("*").alias("cells"))


@query("prj_08_period_bounds", """
SELECT submission_id, period, kind, strftime(first_day, '%Y-%m-%d') AS first_day,
  strftime(last_day, '%Y-%m-%d') AS last_day FROM v_declared""")
def _(spark, sf):
    out = pd.period_bounds(a.declared_periods(spark, sf))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query("prj_09_period_months_days", """
SELECT d.submission_id, d.period, count(DISTINCT strftime(day, '%Y-%m')) AS months, count(*) AS days
FROM (SELECT *, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS day FROM v_declared) d
GROUP BY ALL""")
def _(spark, sf):
    d = a.declared_periods(spark, sf)
    months = pd.period_months(d).groupBy("submission_id", "period").agg(
        F.count_distinct("month").alias("months"))
    days = pd.period_days(d).groupBy("submission_id", "period").agg(F.count("*").alias("days"))
    return months.join(days, ["submission_id", "period"])


@query("sc_04_calendar_keys", """
SELECT order_no, CAST(departure_date - arrival_date AS INTEGER) AS days,
  strftime(arrival_date, '%Y-%m') AS month, year(arrival_date) || '-Q' || quarter(arrival_date)
    AS quarter FROM v_res""")
def _(spark, sf):
    return a.reservations(spark, sf).select(
        "order_no", F.datediff("departure_date", "arrival_date").alias("days"),
        pd.month_label(F.col("arrival_date")).alias("month"),
        pd.quarter_label(F.col("arrival_date")).alias("quarter"))


@query("sc_06_rounding_modes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST((c * 125 + 500) // 1000 AS DOUBLE) / 100 AS half_up,
  CAST(CASE WHEN (c * 125) % 1000 = 500 AND ((c * 125) // 1000) % 2 = 0 THEN (c * 125) // 1000
    ELSE (c * 125 + 500) // 1000 END AS DOUBLE) / 100 AS half_even
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)""")
def _(spark, sf):
    d = (F.col("l_extendedprice").cast("decimal(18,2)") / F.lit(8).cast("decimal(2,0)")).cast(
        "decimal(20,6)")
    return a.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(d, 2).cast("double").alias("half_up"),
        F.bround(d, 2).cast("double").alias("half_even"))


@query("prj_14_presentation_rounding", """
SELECT o_orderkey, CAST(CAST((2 * c + 7) // 14 AS DECIMAL(18,0)) / 100 AS DOUBLE) AS presented
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)""")
def _(spark, sf):
    d = (F.col("o_totalprice").cast("decimal(18,2)") / F.lit(7).cast("decimal(1,0)"))
    return a.table(spark, sf, "orders").select(
        "o_orderkey", F.round(d.cast("decimal(30,12)"), 2).cast("double").alias("presented"))


@query("sc_10_transposed_digits", """
SELECT o_orderkey, CASE WHEN o_orderkey >= 10 AND d[1:1] <> d[2:2]
  THEN CAST(d[2:2] || d[1:1] || d[3:] AS DOUBLE) END AS transposed
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS d FROM orders)""")
def _(spark, sf):
    return a.table(spark, sf, "orders").select("o_orderkey", transpose_digits(
        F.col("o_orderkey")).cast("double").alias("transposed"))


@query("prj_07_key_validity", """
SELECT submission_id, metric_key, CASE WHEN h % 7 = 0 THEN 'unknown_metric'
  WHEN h % 7 = 1 THEN 'bad_period' WHEN h % 7 = 2 AND value_key IS NOT NULL THEN 'not_iso2'
  WHEN h % 7 = 3 AND dimension IS NOT NULL THEN 'half_dimension'
  WHEN h % 7 = 4 AND dimension IS NULL THEN 'dimension_not_allowed' ELSE '' END AS problem
FROM (SELECT *, row + col AS h FROM v_claims)""")
def _(spark, sf):
    from staycheck.functions.keys import key_problem
    h = (F.col("row") + F.col("col")) % 7
    none_dim = (h == 4) & F.col("dimension").isNull()
    c = claims(spark, sf).withColumns({
        "m": F.when(h == 0, "beds").otherwise(F.col("metric")),
        "p": F.when(h == 1, F.concat(F.col("period"), F.lit("x"))).otherwise(F.col("period")),
        "d": F.when(none_dim, "nationality_iso2").otherwise(F.col("dimension")),
        "v": F.when((h == 2) & F.col("value_key").isNotNull(), F.lower("value_key"))
        .when(h == 3, None).when(none_dim, "DE").otherwise(F.col("value_key"))})
    return c.select("submission_id", "metric_key", F.coalesce(key_problem(
        F.col("m"), F.col("p"), F.col("d"), F.col("v")), F.lit("")).alias("problem"))
