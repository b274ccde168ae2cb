"""The same domain views as plans/adapters.py, written for DuckDB, for checking results."""

import re

from staycheck import values
from staycheck.plans.adapters import (ALTERNATIVE, METRIC_NO, NATIONALITIES, OTHER_TOLERANCE, RATES, TWO_KIND_LABELS,
                                      other_policy)
from staycheck.sources.rulesets import rulesets

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the views a query uses, and the views those use, in definition order."""
    needed: set[str] = set()

    def scan(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                scan(VIEWS[name])

    scan(sql)
    bodies = [VIEWS[name] for name in VIEWS if name in needed] + [sql]
    shared = {name for name in needed
              if sum(len(re.findall(rf"\b{name}\b", body)) for body in bodies) > 1}
    ctes = [f"{name} AS {'MATERIALIZED ' if name in shared else ''}({VIEWS[name]})"
            for name in VIEWS if name in needed]
    if not ctes:
        return sql
    head, sql = "WITH RECURSIVE " + ",\n".join(ctes), sql.strip()
    return f"{head},\n{sql[4:]}" if sql.upper().startswith("WITH ") else f"{head}\n{sql}"


def lit(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def rows(table: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in table)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


view("v_res", f"""
SELECT 'H-' || (o_custkey // 150) AS submission_id, 'H-' || (o_custkey // 150) AS hotel_id,
  'RES-' || year(arr) || 'Q' || quarter(arr) || '-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
    AS reservation_id,
  'g_' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS guest_ref,
  ({lit(NATIONALITIES)})[c_nationkey + 1] AS nationality_iso2,
  CAST(1 + o_orderkey % 4 AS INTEGER) AS adults, CAST(o_custkey % 3 AS INTEGER) AS children,
  CAST(1 + o_custkey % 3 AS INTEGER) AS rooms, CAST(o_orderkey % 9 AS INTEGER) AS nights,
  CAST((o_orderkey % 9) * (1 + o_custkey % 3) AS INTEGER) AS room_nights,
  arr AS arrival_date, arr + CAST(o_orderkey % 9 AS INTEGER) AS departure_date,
  CASE WHEN o_orderstatus = 'F' THEN 'CHECKED_OUT' WHEN o_orderstatus = 'O' THEN 'IN_HOUSE'
       WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'CANCELLED' ELSE 'NO_SHOW' END
    AS status,
  ({lit(RATES)})[CAST(o_orderkey % 7 AS INTEGER) + 1] AS rate_code, o_orderkey AS order_no
FROM (SELECT *, CAST(o_orderdate AS DATE) AS arr FROM orders) o
JOIN customer c ON c.c_custkey = o.o_custkey""")

view("v_rows", """
SELECT * EXCLUDE (rn), CAST(1 + (rn - 1) // 30 AS INTEGER) AS page,
  CAST(1 + (rn - 1) % 30 AS INTEGER) AS row_no
FROM (SELECT *, 'pms_' || strftime(arrival_date, '%Y-%m') || '.pdf' AS file,
        row_number() OVER (PARTITION BY submission_id, strftime(arrival_date, '%Y-%m')
                           ORDER BY arrival_date, order_no) AS rn FROM v_res)""")

view("v_hotels", """
SELECT DISTINCT 'H-' || (c_custkey // 150) AS submission_id, c_custkey // 150 AS hotel_no
FROM customer""")

view("v_inv", """
SELECT submission_id, submission_id AS hotel_id, day,
  CAST(40 + hotel_no % 10 AS INTEGER) AS rooms_total,
  CAST(CASE WHEN day(day) BETWEEN 10 AND 12 THEN 3 ELSE 0 END AS INTEGER) AS rooms_out_of_order,
  'inventory_' || year(day) || '-Q' || quarter(day) || '.csv' AS file,
  CAST(day - CAST(date_trunc('quarter', day) AS DATE) + 1 AS INTEGER) AS row_no
FROM (SELECT *, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-31',
                                            INTERVAL 1 DAY)) AS DATE) AS day
      FROM v_hotels WHERE hotel_no % 10 <> 7)
WHERE NOT (hotel_no % 10 = 3 AND strftime(day, '%Y-%m') = '1997-02')
  AND NOT (hotel_no % 10 = 5 AND day = DATE '1998-03-17')""")

view("v_months", """
SELECT CAST(m AS DATE) AS m0, strftime(m, '%Y-%m') AS month,
  year(m) || '-Q' || quarter(m) AS quarter, CAST(year(m) AS VARCHAR) AS year
FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS m)""")

view("v_periods", """
SELECT month AS period, 'month' AS kind, m0 AS first_day,
  CAST(m0 + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_day FROM v_months
UNION ALL
SELECT DISTINCT quarter, 'quarter', CAST(date_trunc('quarter', m0) AS DATE),
  CAST(date_trunc('quarter', m0) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) FROM v_months
UNION ALL
SELECT DISTINCT year, 'year', CAST(date_trunc('year', m0) AS DATE),
  CAST(date_trunc('year', m0) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) FROM v_months""")

view("v_declared", """
SELECT h.submission_id, h.hotel_no, p.* FROM v_hotels h, v_periods p""")

def rule_rows(rules) -> str:
    return rows(
        [(r.ruleset_id, r.ord, r.applies_to, r.status_in, r.rate_in, r.denominator, r.occ_month_basis,
          r.exclude_out_of_order, r.day_use_counts_room_nights, r.counts, r.include_children,
          r.nat_month_basis) for r in rules],
        "ruleset_id, ord, applies_to, status_in, rate_in, denominator, occ_month_basis, "
        "exclude_out_of_order, day_use_counts_room_nights, counts, include_children, nat_month_basis")


view("v_rules", rule_rows(rulesets()))

# every reservation in every period it touches; stays are shorter than a month, so they touch those of their
# first and last day
view("v_touch", """
SELECT r.*, p.kind, p.first_day, p.last_day,
  greatest(0, CAST(least(r.departure_date, p.last_day + 1) - greatest(r.arrival_date, p.first_day)
    AS INTEGER)) AS nights_in,
  r.arrival_date BETWEEN p.first_day AND p.last_day AS arrives,
  r.departure_date BETWEEN p.first_day AND p.last_day AS departs
FROM (SELECT *, unnest(list_distinct([strftime(arrival_date, '%Y-%m'), strftime(departure_date, '%Y-%m'),
    year(arrival_date) || '-Q' || quarter(arrival_date), year(departure_date) || '-Q' || quarter(departure_date),
    CAST(year(arrival_date) AS VARCHAR), CAST(year(departure_date) AS VARCHAR)])) AS period FROM v_res) r
JOIN v_periods p USING (period)""")

view("v_soldsum", """
SELECT submission_id, period, status, rate_code, count(*) AS touched,
  sum(CASE WHEN nights = 0 AND arrives THEN rooms ELSE 0 END) AS day_use,
  sum(CASE WHEN nights > 0 THEN rooms * nights_in ELSE 0 END) AS occupied,
  sum(CASE WHEN nights > 0 AND arrives THEN room_nights ELSE 0 END) AS arriving,
  sum(CASE WHEN nights > 0 AND departs THEN room_nights ELSE 0 END) AS departing
FROM v_touch GROUP BY ALL""")

view("v_sold", """
SELECT t.submission_id, t.period, q.ruleset_id, CAST(sum(touched) AS BIGINT) AS touched,
  CAST(sum(CASE WHEN q.day_use_counts_room_nights THEN day_use ELSE 0 END + CASE q.occ_month_basis
    WHEN 'occupied_night' THEN occupied WHEN 'arrival_month' THEN arriving ELSE departing END) AS BIGINT) AS sold
FROM v_soldsum t JOIN v_rules q
  ON list_contains(q.status_in, t.status) AND list_contains(q.rate_in, t.rate_code)
GROUP BY ALL""")

view("v_guestsum", """
SELECT submission_id, period, nationality_iso2, status, rate_code, arrives, departs,
  nights_in > 0 OR (nights = 0 AND arrives) AS present, count(*) AS stays, sum(room_nights) AS room_nights,
  sum(adults) AS adults, sum(children) AS children
FROM v_touch GROUP BY ALL""")

view("v_guests", """
SELECT t.submission_id, t.period, t.nationality_iso2, q.ruleset_id,
  CAST(sum(CASE q.counts WHEN 'arrivals' THEN stays WHEN 'room_nights' THEN room_nights
    ELSE adults + CASE WHEN q.include_children THEN children ELSE 0 END END) AS BIGINT) AS guests
FROM v_guestsum t JOIN v_rules q
  ON list_contains(q.status_in, t.status) AND list_contains(q.rate_in, t.rate_code)
WHERE CASE q.nat_month_basis WHEN 'arrival_month' THEN arrives WHEN 'departure_month' THEN departs
  ELSE present END
GROUP BY ALL""")

view("v_invp", """
SELECT submission_id, period, count(*) AS days,
  CAST(sum(rooms_total - rooms_out_of_order) AS BIGINT) AS net,
  CAST(sum(rooms_total) AS BIGINT) AS gross,
  max(rooms_total - rooms_out_of_order) AS max_net, max(rooms_total) AS max_gross
FROM (SELECT *, unnest([strftime(day, '%Y-%m'), year(day) || '-Q' || quarter(day), CAST(year(day) AS VARCHAR)]) AS period
  FROM v_inv) GROUP BY ALL""")

# value per submission, key and ruleset; nv says why there is none
view("v_values", """
SELECT submission_id, metric, period, dimension, value_key, ruleset_id, ord,
  metric || ':' || period || CASE WHEN dimension IS NULL THEN ''
    ELSE ':' || dimension || '=' || value_key END AS metric_key,
  CAST(v AS DECIMAL(38,10)) AS v, nv
FROM (
  SELECT d.submission_id, 'room_nights_sold' AS metric, d.period, CAST(NULL AS VARCHAR) AS dimension,
    CAST(NULL AS VARCHAR) AS value_key, q.ruleset_id, q.ord,
    CASE WHEN s.touched > 0 THEN CAST(s.sold AS DECIMAL(38,10)) END AS v,
    CASE WHEN s.touched IS NULL THEN 'no_source_rows' END AS nv
  FROM v_declared d CROSS JOIN v_rules q
  LEFT JOIN v_sold s ON s.submission_id = d.submission_id AND s.period = d.period
    AND s.ruleset_id = q.ruleset_id
  WHERE list_contains(q.applies_to, 'room_nights_sold')
  UNION ALL
  SELECT d.submission_id, 'room_nights_available', d.period, NULL, NULL, q.ruleset_id, q.ord,
    CASE WHEN i.days > 0 THEN CAST(CASE WHEN q.exclude_out_of_order THEN i.net ELSE i.gross END
      AS DECIMAL(38,10)) END,
    CASE WHEN h.submission_id IS NULL THEN 'missing_inventory_reference'
         WHEN i.days IS NULL THEN 'no_source_rows' END
  FROM v_declared d CROSS JOIN v_rules q
  LEFT JOIN (SELECT DISTINCT submission_id FROM v_inv) h ON h.submission_id = d.submission_id
  LEFT JOIN v_invp i ON i.submission_id = d.submission_id AND i.period = d.period
  WHERE list_contains(q.applies_to, 'room_nights_available')
  UNION ALL
  SELECT submission_id, 'occupancy_pct', period, NULL, NULL, ruleset_id, ord,
    CASE WHEN nv IS NULL THEN CASE WHEN den = 0 THEN 0
      ELSE CAST((20000 * sold + den) // (2 * den) AS DECIMAL(18,0)) / 100 END END, nv
  FROM (SELECT d.submission_id, d.period, q.ruleset_id, q.ord, coalesce(s.sold, 0) AS sold,
      coalesce(CASE WHEN q.denominator = 'rooms_available'
        THEN CASE WHEN q.exclude_out_of_order THEN i.max_net ELSE i.max_gross END
        ELSE CASE WHEN q.exclude_out_of_order THEN i.net ELSE i.gross END END, 0) AS den,
      CASE WHEN h.submission_id IS NULL THEN 'missing_inventory_reference'
           WHEN i.days IS NULL AND s.touched IS NULL THEN 'no_source_rows' END AS nv
    FROM v_declared d CROSS JOIN v_rules q
    LEFT JOIN (SELECT DISTINCT submission_id FROM v_inv) h ON h.submission_id = d.submission_id
    LEFT JOIN v_invp i ON i.submission_id = d.submission_id AND i.period = d.period
    LEFT JOIN v_sold s ON s.submission_id = d.submission_id AND s.period = d.period
      AND s.ruleset_id = q.ruleset_id
    WHERE list_contains(q.applies_to, 'occupancy_pct'))
  UNION ALL
  SELECT g.submission_id, 'guests_by_nationality', g.period, 'nationality_iso2',
    g.nationality_iso2, g.ruleset_id, q.ord, CAST(g.guests AS DECIMAL(38,10)), NULL
  FROM v_guests g JOIN v_rules q USING (ruleset_id)
  JOIN v_declared d ON d.submission_id = g.submission_id AND d.period = g.period
  WHERE list_contains(q.applies_to, 'guests_by_nationality')
)""")

view("v_base", """
SELECT * FROM v_values WHERE ruleset_id = 'BASELINE'""")
view("v_perm", """
SELECT * FROM v_values WHERE ruleset_id <> 'BASELINE' AND v IS NOT NULL""")


def col_letters(n: str) -> str:
    return (f"CASE WHEN {n} <= 26 THEN chr(64 + CAST({n} AS INTEGER)) "
            f"WHEN {n} <= 702 THEN chr(CAST(65 + ({n} - 27) // 26 AS INTEGER)) || "
            f"chr(CAST(65 + ({n} - 27) % 26 AS INTEGER)) END")


def transposed(v: str) -> str:
    d = f"CAST(CAST({v} AS BIGINT) AS VARCHAR)"
    return (f"CASE WHEN {v} = floor({v}) AND length({d}) >= 2 "
            f"AND substring({d},1,1) <> substring({d},2,1) THEN CAST(substring({d},2,1) || "
            f"substring({d},1,1) || substring({d},3) AS DECIMAL(38,10)) END")


POSITION = """CASE WHEN length(period) = 7 AND period[6:6] <> 'Q'
    THEN (CAST(period[1:4] AS INTEGER) - 1995) * 12 + CAST(period[6:7] AS INTEGER) - 1
  WHEN length(period) = 7 THEN 100 + (CAST(period[1:4] AS INTEGER) - 1995) * 4
    + CAST(period[7:7] AS INTEGER) - 1
  ELSE 200 + CAST(period AS INTEGER) - 1995 END"""
METRIC_CASE = "CASE metric " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in METRIC_NO.items()) + " END"
ALT_CASE = "CASE metric " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ALTERNATIVE.items()) + " END"

view("v_keys", """
SELECT submission_id, metric, period, dimension, value_key, metric_key,
  max(v) FILTER (ruleset_id = 'BASELINE') AS v, max(nv) FILTER (ruleset_id = 'BASELINE') AS nv,
  max(v) FILTER (ruleset_id = 'P-HOUSE-INCLUDED') AS house,
  max(v) FILTER (ruleset_id = """ + ALT_CASE + """) AS alt
FROM v_values GROUP BY ALL""")

view("v_filed", f"""
SELECT *, CAST(CASE WHEN hotel_no % 5 = 4 THEN v
  WHEN v IS NULL AND nv IS NULL THEN CASE WHEN h = 5 THEN house END
  WHEN v IS NULL THEN CASE WHEN h = 5 THEN house WHEN h = 6 THEN 50 END
  WHEN h = 0 THEN v + 1
  WHEN h = 1 THEN coalesce({transposed('v')}, v)
  WHEN h = 2 THEN coalesce(alt, v)
  WHEN h = 3 THEN NULL
  WHEN h = 4 AND metric = 'occupancy_pct' THEN v + 0.05 ELSE v END AS DECIMAL(38,10)) AS filed
FROM (SELECT *, CAST(submission_id[3:] AS INTEGER) AS hotel_no,
    (ascii(period[-1:]) + ascii(period[4:4]) * 3 + CAST(submission_id[3:] AS INTEGER) * 5
     + ({METRIC_CASE}) * 7
     + CASE WHEN value_key IS NULL THEN 0 ELSE ascii(value_key) + ascii(value_key[-1:]) * 2 END
    ) % 12 AS h FROM v_keys)""")

view("v_claims", f"""
SELECT *, {col_letters('col')} || CAST(row AS VARCHAR) AS cell,
  metric || ':' || period || CASE WHEN dimension IS NULL THEN ''
    ELSE ':' || dimension || '=' || value_key END AS metric_key
FROM (SELECT submission_id, metric, period, dimension, value_key, value,
    CASE WHEN dimension IS NULL THEN 'Occupancy' ELSE 'Nationality' END AS sheet,
    CAST(CASE WHEN dimension IS NULL THEN 5 + {POSITION}
      ELSE 4 + list_position({lit(NATIONALITIES + ['XK'])}, value_key) END AS INTEGER) AS row,
    CAST(CASE WHEN dimension IS NULL THEN 1 + {METRIC_CASE} ELSE 2 + {POSITION} END AS INTEGER)
      AS col
  FROM (SELECT submission_id, metric, period, dimension, value_key, filed AS value FROM v_filed
        WHERE filed IS NOT NULL
        UNION ALL
        SELECT submission_id, 'guests_by_nationality', period, 'nationality_iso2', 'XK',
          CAST(5 AS DECIMAL(38,10)) FROM v_filed WHERE metric = 'room_nights_sold' AND h = 7))""")

view("v_pairs", """
SELECT coalesce(c.submission_id, b.submission_id) AS submission_id,
  coalesce(c.metric_key, b.metric_key) AS metric_key, coalesce(c.metric, b.metric) AS metric,
  coalesce(c.period, b.period) AS period, coalesce(c.dimension, b.dimension) AS dimension,
  coalesce(c.value_key, b.value_key) AS value_key, c.value AS claimed, c.sheet, c.cell,
  b.v AS computed, b.nv,
  CASE WHEN b.nv IS NOT NULL THEN 'not_verifiable'
    WHEN c.value IS NOT NULL AND b.v IS NOT NULL THEN 'matched'
    WHEN c.value IS NOT NULL THEN 'orphan_claim' ELSE 'missing_claim' END AS pairing
FROM v_claims c FULL JOIN v_base b
  ON c.submission_id = b.submission_id AND c.metric_key = b.metric_key""")

view("v_explained", """
SELECT p.submission_id, p.metric_key, q.ruleset_id, q.ord FROM v_pairs p JOIN v_perm q
  ON p.submission_id = q.submission_id AND p.metric_key = q.metric_key
WHERE abs(p.claimed - q.v) <= CASE WHEN p.metric = 'occupancy_pct' THEN 0.10 ELSE 0 END
  AND (p.computed IS NULL OR abs(p.claimed - p.computed)
       > CASE WHEN p.metric = 'occupancy_pct' THEN 0.10 ELSE 0 END)""")

view("v_classes", rows(values.CLASS_RULES,
                       "variance_class, class_name, severity, proposes, escalates_to"))

view("v_class", """
SELECT p.*, e.ids, CASE WHEN pairing = 'matched' AND claimed = computed THEN NULL
  WHEN pairing = 'not_verifiable' AND claimed IS NULL THEN NULL
  WHEN pairing = 'not_verifiable' THEN 'V7' WHEN e.ids IS NOT NULL THEN 'V2'
  WHEN pairing IN ('missing_claim', 'orphan_claim') THEN 'V5'
  WHEN abs(claimed - computed) > CASE WHEN metric = 'occupancy_pct' THEN 0.10 ELSE 0 END THEN 'V1'
  ELSE 'V6' END AS variance_class
FROM v_pairs p LEFT JOIN (SELECT submission_id, metric_key, list(ruleset_id ORDER BY ord) AS ids
  FROM v_explained GROUP BY ALL) e USING (submission_id, metric_key)""")

view("v_allfind", """
SELECT c.submission_id, c.metric_key, c.metric, c.period, c.dimension, c.value_key,
  c.variance_class, k.severity, k.escalates_to, c.claimed, c.computed,
  c.claimed - c.computed AS difference, CASE WHEN k.proposes THEN c.computed END AS correction,
  CASE WHEN c.variance_class = 'V2' THEN c.ids[1] END AS explaining,
  CASE WHEN c.variance_class = 'V2' THEN c.ids[2:] ELSE [] END AS also, c.sheet, c.cell,
  CASE WHEN c.variance_class = 'V7' AND nv = 'missing_inventory_reference' THEN 'D-RNA-04'
    WHEN c.variance_class = 'V7' THEN 'D-CLS-01' WHEN c.variance_class = 'V2' THEN 'D-CLS-07'
    WHEN pairing = 'orphan_claim' THEN 'D-MAT-05' WHEN c.variance_class = 'V5' THEN 'D-MAT-04'
    WHEN c.variance_class = 'V1' THEN 'D-CLS-04' ELSE 'D-TOL-04' END AS clause
FROM v_class c JOIN v_classes k ON c.variance_class = k.variance_class""")

view("v_find", """
SELECT *, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY submission_id
    ORDER BY variance_class = 'V2', metric_key) AS VARCHAR), 4, '0') AS finding_id
FROM v_allfind WHERE severity <> 'informational'""")

# report rows behind each finding
view("v_rowper", """
SELECT DISTINCT r.submission_id, r.nationality_iso2, r.status, r.rate_code, r.file, r.page,
  r.row_no, r.reservation_id, t.period
FROM v_rows r JOIN v_touch t USING (submission_id, order_no)""")

view("v_cited", """
SELECT f.submission_id, f.metric_key, 'pdf' AS source_kind, r.file, r.page, r.row_no
FROM v_find f JOIN v_rules q ON q.ruleset_id = coalesce(f.explaining, 'BASELINE')
JOIN v_rowper r ON r.submission_id = f.submission_id AND r.period = f.period
  AND list_contains(q.status_in, r.status) AND list_contains(q.rate_in, r.rate_code)
  AND (f.value_key IS NULL OR f.value_key = r.nationality_iso2)
WHERE f.metric <> 'room_nights_available' AND (f.computed IS NOT NULL OR f.explaining IS NOT NULL)
UNION ALL
SELECT f.submission_id, f.metric_key, 'inventory', i.file, NULL, i.row_no
FROM v_find f JOIN v_periods p ON p.period = f.period
JOIN v_inv i ON i.submission_id = f.submission_id AND i.day BETWEEN p.first_day AND p.last_day
WHERE f.metric IN ('room_nights_available', 'occupancy_pct')
  AND (f.computed IS NOT NULL OR f.explaining IS NOT NULL)""")

view("v_evidence", """
SELECT submission_id, metric_key, source_kind, file, page,
  CAST(min(row_no) AS INTEGER) AS row_start, CAST(max(row_no) AS INTEGER) AS row_end
FROM (SELECT *, row_no - row_number() OVER (
    PARTITION BY submission_id, metric_key, source_kind, file, page ORDER BY row_no) AS g
  FROM (SELECT DISTINCT * FROM v_cited))
GROUP BY submission_id, metric_key, source_kind, file, page, g""")

view("v_findsrc", """
SELECT f.*, coalesce(e.source_kind, 'not_reached') AS source_kind, e.file AS source_file,
  e.page AS source_page, e.row_start AS source_row_start, e.row_end AS source_row_end
FROM v_find f LEFT JOIN (SELECT * FROM v_evidence QUALIFY row_number() OVER (
    PARTITION BY submission_id, metric_key
    ORDER BY source_kind = 'inventory', file, page, row_start) = 1) e
  USING (submission_id, metric_key)""")

view("v_reviews", """
SELECT 'H-' || (user_id // 15) AS submission_id,
  'F-' || lpad(CAST(event_id % 500 + 1 AS VARCHAR), 4, '0') AS finding_id,
  CASE event_type WHEN 'purchase' THEN 'amend' WHEN 'view' THEN 'reject' ELSE 'accept' END
    AS decision,
  CASE WHEN event_id % 37 = 0 THEN ' ' WHEN event_id % 41 = 0 THEN 'a' || chr(10) || 'b'
    ELSE 'officer ' || user_id END AS reviewer,
  CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0
    THEN CASE WHEN event_id % 7 = 0 THEN 'NaN' ELSE CAST(event_id % 100 AS VARCHAR) END
    WHEN event_id % 43 = 0 THEN '1' END AS amended_value, event_id AS seq FROM events""")

view("v_summary", """
SELECT h.submission_id, coalesce(a.findings, 0) AS findings,
  coalesce(a.definitional_items, 0) AS definitional_items,
  coalesce(a.hotel_errors, 0) AS hotel_errors, coalesce(a.blocking, 0) AS blocking,
  coalesce(a.material, 0) AS material, coalesce(a.informational, 0) AS informational,
  coalesce(a.undecided_findings, 0) AS undecided_findings,
  coalesce(n.nv, 0) AS not_verifiable, CAST(0 AS BIGINT) AS out_of_scope_claims
FROM v_hotels h LEFT JOIN (
  SELECT f.submission_id, count(*) FILTER (variance_class <> 'V2') AS findings,
    count(*) FILTER (variance_class = 'V2') AS definitional_items,
    count(*) FILTER (variance_class IN ('V1', 'V5')) AS hotel_errors,
    count(*) FILTER (severity = 'blocking') AS blocking,
    count(*) FILTER (severity = 'material') AS material,
    count(*) FILTER (severity = 'informational') AS informational,
    count(*) FILTER (r.finding_id IS NULL) AS undecided_findings
  FROM v_find f LEFT JOIN (SELECT DISTINCT submission_id, finding_id FROM v_reviews) r
    USING (submission_id, finding_id) GROUP BY ALL) a USING (submission_id)
LEFT JOIN (SELECT submission_id, count(*) AS nv FROM v_pairs
  WHERE pairing = 'not_verifiable' AND claimed IS NULL GROUP BY ALL) n USING (submission_id)""")

view("v_verdicts", """
SELECT *, CASE WHEN blocking > 0 THEN 'HALTED' WHEN definitional_items > 0 THEN 'ESCALATED'
  WHEN findings > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v_summary""")

view("v_narr", """
SELECT f.submission_id, f.finding_id, f.explaining, f.also, n,
  CASE WHEN n % 17 = 0 THEN 'F-0000' ELSE f.finding_id END AS echoed_id,
  CASE WHEN n % 3 = 0 THEN f.explaining WHEN n % 19 = 0 THEN 'P-OOO-INCLUDED' END AS cites,
  repeat(f.metric_key || ' ', CASE WHEN n % 23 = 0 THEN 30 ELSE 1 END) AS sentence
FROM (SELECT *, CAST(finding_id[3:6] AS INTEGER) AS n FROM v_find) f""")

view("v_print", """
SELECT * EXCLUDE (line), CAST(1 + (line - 1) // 30 AS INTEGER) AS page,
  CAST(1 + (line - 1) % 30 AS INTEGER) AS row_no
FROM (SELECT t.* EXCLUDE (rooms), t.period AS month, 'pms_' || t.period || '.pdf' AS file, c.copy,
    CAST(rooms * nights_in AS BIGINT) AS room_nights_month,
    CAST(CASE WHEN NOT arrives AND order_no % 53 = 0 THEN rooms + 1 ELSE rooms END AS INTEGER)
      AS rooms,
    row_number() OVER (PARTITION BY submission_id, t.period ORDER BY arrival_date, order_no, copy)
      AS line
  FROM v_touch t JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR t.order_no % 71 = 0
  WHERE t.kind = 'month' AND (t.arrives OR t.nights_in > 0))""")

view("v_cells", """
SELECT submission_id, file, page, row_no, order_no, copy, reservation_id, guest_ref,
  nationality_iso2 AS nationality,
  CASE WHEN order_no % 83 = 0 THEN strftime(arrival_date, '%d/%m/%Y')
    ELSE strftime(arrival_date, '%Y-%m-%d') END AS arrival,
  CASE WHEN nights = 0 THEN '- day use -' ELSE strftime(departure_date, '%Y-%m-%d') END AS departure,
  CAST(nights + CASE WHEN order_no % 67 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS nights,
  CAST(rooms AS VARCHAR) AS rooms,
  CASE WHEN order_no % 89 = 0 THEN 'two' ELSE CAST(adults AS VARCHAR) END AS adults,
  CAST(children AS VARCHAR) AS children, CAST(room_nights AS VARCHAR) AS room_nights_total,
  CAST(room_nights_month AS VARCHAR) AS room_nights_month, rate_code,
  CASE status WHEN 'CHECKED_OUT' THEN 'Checked Out' WHEN 'IN_HOUSE' THEN 'In House'
    WHEN 'CANCELLED' THEN 'Cancelled' ELSE 'No Show' END AS status
FROM v_print""")

QUALIFIES = ("(status IN ('CHECKED_OUT', 'IN_HOUSE') AND rate_code <> 'HOUSE')")
EXCLUSION = f"""CASE WHEN status = 'CANCELLED' THEN 'cancelled' WHEN status = 'NO_SHOW'
  THEN 'no_show' WHEN rate_code = 'HOUSE' THEN 'house_use'
  WHEN nights = 0 AND {QUALIFIES} THEN 'day_use' END"""


def extracted(source: str) -> str:
    named = " UNION ALL ".join(
        f"SELECT submission_id, month, '{name}' AS check_name, '' AS code, "
        f"CAST({value} AS BIGINT) AS value FROM {source} GROUP BY ALL"
        for name, value in [
            ("listed_rows", "count(*)"), ("listed_room_nights", "sum(room_nights_month)"),
            ("sold", f"sum(CASE WHEN {QUALIFIES} THEN rooms * nights_in ELSE 0 END)"),
            *[(x, f"count(*) FILTER ({EXCLUSION} = '{x}')") for _, x in values.EXCLUSION_LABELS],
            ("total_guests", f"coalesce(sum(adults + children) FILTER ({QUALIFIES} AND arrives), 0)"),
        ])
    return named + f""" UNION ALL SELECT submission_id, month, 'guests', nationality_iso2,
      CAST(sum(adults + children) AS BIGINT) FROM {source} WHERE {QUALIFIES} AND arrives
      GROUP BY ALL"""


view("v_single", "SELECT * FROM v_print WHERE copy = 1")
view("v_extracted", extracted("v_print"))
view("v_printed", f"""
SELECT submission_id, month, check_name, code, CASE
    WHEN check_name = 'day_use' AND m = 6 THEN NULL
    WHEN check_name = 'total_guests' AND m = 7 THEN NULL
    ELSE value + CASE WHEN check_name = 'sold' AND m = 3 THEN 1
      WHEN check_name = 'cancelled' AND m = 4 THEN 1
      WHEN check_name = 'guests' AND code = 'DE' AND m = 5 THEN 2 ELSE 0 END END AS value
FROM (SELECT *, CAST(month[6:7] AS INTEGER) AS m FROM ({extracted('v_single')}))""")

_names = [c[2] for n in NATIONALITIES for c in values.COUNTRIES if c[0] == n]
_alpha3 = [c[1] for n in NATIONALITIES for c in values.COUNTRIES if c[0] == n]
view("v_labels", f"""
SELECT submission_id, custkey, label,
  trim(regexp_replace(regexp_replace(lower(trim(label)), '[^0-9a-z ]+', '', 'g'), ' +', ' ', 'g'))
    AS alias_key
FROM (SELECT 'H-' || (c_custkey // 150) AS submission_id, c_custkey AS custkey,
  CASE WHEN c_custkey % 6 = 0 THEN upper(name)
    WHEN c_custkey % 6 = 1 THEN ({lit(_alpha3)})[c_nationkey + 1]
    WHEN c_custkey % 6 = 2 THEN ' ' || lower(name) || '  '
    WHEN c_custkey % 6 = 3 THEN replace(name, ' ', '  ') || '.'
    WHEN c_custkey % 6 = 4 THEN ({lit(NATIONALITIES)})[c_nationkey + 1]
    WHEN c_custkey % 36 = 5 THEN 'Austrlia' WHEN c_custkey % 18 = 5 THEN 'Mongolia' WHEN c_custkey % 18 = 11 THEN substring(name, 2)
    ELSE name END AS label
  FROM (SELECT *, ({lit(_names)})[c_nationkey + 1] AS name FROM customer))""")

view("v_alias", "SELECT DISTINCT code, trim(regexp_replace(regexp_replace(lower(trim(label)), "
     "'[^0-9a-z ]+', '', 'g'), ' +', ' ', 'g')) AS alias_key FROM (" + rows(
         [(code, label) for code, a3, name, more in values.COUNTRIES
          for label in (code, a3, name, *more)], "code, label") + ")")

view("v_kinds", "SELECT DISTINCT kind, code, trim(regexp_replace(regexp_replace(lower(trim(label)), "
     "'[^0-9a-z ]+', '', 'g'), ' +', ' ', 'g')) AS alias_key FROM (" + rows(
         [("country", code, label) for code, a3, name, more in values.COUNTRIES
          for label in (code, a3, name, *more)]
         + [(kind, code, label) for kind, table in (("status", values.STATUS_ALIASES),
                                                    ("rate code", values.RATE_CODE_ALIASES))
            for code, more in table for label in (code, *more)], "kind, code, label") + ")")

view("v_kind_labels", f"""
SELECT *, trim(regexp_replace(regexp_replace(lower(trim(label)), '[^0-9a-z ]+', '', 'g'), ' +', ' ', 'g')) AS alias_key
FROM (SELECT custkey, coalesce(({lit(TWO_KIND_LABELS)})[custkey % 35 + 1], label) AS label FROM v_labels)""")

view("v_moved_labels", """
SELECT DISTINCT label,
  trim(regexp_replace(regexp_replace(lower(trim(label)), '[^0-9a-z ]+', '', 'g'), ' +', ' ', 'g')) AS alias_key
FROM (SELECT CASE WHEN custkey % 4 = 0 AND last <> '' THEN last || ' ' || regexp_replace(name, ' +[^ ]+$', '')
    WHEN custkey % 4 = 1 AND last <> '' THEN regexp_replace(name, ' +[^ ]+$', '')
    WHEN custkey % 24 = 3 THEN 'Arabia' WHEN custkey % 24 = 7 THEN 'Republic of Korea' ELSE label END AS label
  FROM (SELECT custkey, label, trim(label) AS name, regexp_extract(trim(label), ' ([^ ]+)$', 1) AS last FROM v_labels))""")

view("v_asked", """
SELECT label, alias_key AS k FROM (SELECT label, alias_key FROM v_labels UNION SELECT label, alias_key FROM v_moved_labels)
WHERE alias_key <> '' AND alias_key NOT IN (SELECT alias_key FROM v_alias)""")

# matching-block ratio of every label to every alias: the longest block two texts share (the first of them in
# the one, then in the other), and again what lies before it on both sides and what lies after it
_block = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(
  range(1, length(x) - i + 2), lambda z: contains(y, substring(x, i, z))), lambda z: {'z': z, 'i': -i}))))"""
view("v_ratio", f"""
SELECT k, alias, 2.0::DOUBLE * sum(n) / (length(k) + length(alias)) AS score FROM (
  WITH RECURSIVE todo AS (
    SELECT k, alias_key AS alias, k AS x, alias_key AS y, 0 AS n FROM (SELECT DISTINCT k FROM v_asked), v_alias
    GROUP BY ALL
    UNION ALL
    SELECT k, alias, part.x, part.y, part.n FROM (
      SELECT k, alias, unnest([
        {{'x': left(x, i - 1), 'y': left(y, j - 1), 'n': z}}, {{'x': substring(x, i + z), 'y': substring(y, j + z), 'n': 0}}]) AS part
      FROM (SELECT *, instr(y, substring(x, i, z)) AS j FROM (
        SELECT k, alias, x, y, -m.i AS i, m.z AS z FROM (SELECT *, {_block} AS m FROM todo WHERE x <> '' AND y <> ''))
        WHERE z IS NOT NULL))
    WHERE part.n > 0 OR (part.x <> '' AND part.y <> ''))
  SELECT * FROM todo) GROUP BY k, alias""")

view("v_shortlist", """
SELECT label, rank, alias, code, score, left_out FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, alias, code) AS rank,
    greatest(count(*) OVER (PARTITION BY label) - 5, 0) AS left_out
  FROM (SELECT * FROM (SELECT u.label, a.code, r.alias, r.score
      FROM v_asked u JOIN v_ratio r USING (k) JOIN v_alias a ON a.alias_key = r.alias)
    WHERE score >= 0.6::DOUBLE
    QUALIFY alias = first_value(alias) OVER (PARTITION BY label, code ORDER BY score DESC, alias)))
WHERE rank <= 5""")

view("v_files", """
SELECT 'H-' || (doc_id // 100) AS submission_id, doc_id, text AS content,
  CASE WHEN n = 17 THEN 'pms_draft.pdf'
    WHEN n < 80 THEN 'pms_' || strftime(DATE '1995-01-01' + to_months(CAST(n AS INTEGER)), '%Y-%m')
      || '.pdf'
    WHEN n < 85 THEN 'pms_' || strftime(DATE '1995-01-01' + to_months(CAST(n - 80 AS INTEGER)),
      '%Y-%m') || '.pdf'
    WHEN n < 90 THEN 'pms_2002-0' || (n - 84) || '.pdf'
    WHEN n < 95 THEN 'pms_report' || n || '_final.pdf'
    WHEN n = 95 THEN 'claims_1995-Q1.xlsx' ELSE 'inventory_1995-Q1.csv' END AS name
FROM (SELECT *, doc_id % 100 AS n FROM documents)""")
view("v_reports", """
SELECT *, CASE WHEN regexp_matches(name, '_[0-9]{4}-[0-9]{2}\\.pdf$')
  THEN regexp_extract(name, '([0-9]{4}-[0-9]{2})', 1) END AS month
FROM v_files WHERE name LIKE 'pms@_%.pdf' ESCAPE '@'""")
view("v_fileprob", """
SELECT submission_id, 'unnamed_month' AS problem, name AS subject FROM v_reports WHERE month IS NULL
UNION ALL SELECT DISTINCT submission_id, 'foreign_month', month FROM v_reports
  WHERE month IS NOT NULL AND (submission_id, month) NOT IN (
    SELECT (submission_id, period) FROM v_declared WHERE kind = 'month')
UNION ALL SELECT submission_id, 'two_for_one_month', month FROM v_reports
  WHERE month IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT submission_id, 'missing_month', period FROM v_declared WHERE kind = 'month'
  AND (submission_id, period) NOT IN (SELECT (submission_id, month) FROM v_reports
    WHERE month IS NOT NULL)""")

_month_words = "['" + "','".join(n[0].capitalize() for n in values.MONTH_NAMES) + "']"
_nat_names = "CASE value_key " + " ".join(
    f"WHEN '{n}' THEN {lit(name)}" for n, name in zip(NATIONALITIES, _names)) + " ELSE 'Xanadu' END"
view("v_wcells", f"""
SELECT submission_id, sheet, row, col, text, CASE WHEN text IS NULL THEN
    CASE WHEN metric = 'occupancy_pct' AND row % 3 = 0 THEN value / 100 ELSE value END END AS number,
  'figure' AS role
FROM (SELECT *, CASE WHEN (row + col) % 31 = 0 THEN '=SUM(B2:B4)'
    WHEN metric = 'occupancy_pct' THEN CASE WHEN row % 3 = 1
      THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '%' END
    WHEN (row + col) % 5 = 0 THEN format('{{:,}}', CAST(value AS BIGINT))
    WHEN (row + col) % 5 = 1 THEN 'AED ' || CAST(value AS BIGINT) END AS text FROM v_claims)
UNION ALL
SELECT submission_id, sheet, CASE WHEN sheet = 'Occupancy' THEN pos + 5 ELSE 4 END,
  CASE WHEN sheet = 'Occupancy' THEN 1 ELSE pos + 2 END,
  CASE WHEN period LIKE '%Q%' THEN period || ' total' WHEN length(period) = 7 AND pos % 3 = 0
    THEN ({_month_words})[CAST(period[6:7] AS INTEGER)] || ' ' || period[1:4] ELSE period END,
  NULL, 'period'
FROM (SELECT DISTINCT submission_id, sheet, period, {POSITION} AS pos FROM v_claims)
UNION ALL
SELECT DISTINCT submission_id, sheet, row, 1, {_nat_names}, NULL::DECIMAL(38,10), 'dimension'
FROM v_claims WHERE value_key IS NOT NULL
UNION ALL
SELECT submission_id, sheet, 31, pos + 2, NULL, total + CASE WHEN pos % 9 = 0 THEN 3 ELSE 0 END,
  'total'
FROM (SELECT submission_id, sheet, period, {POSITION} AS pos, sum(value) AS total FROM v_claims
  WHERE value_key IS NOT NULL GROUP BY ALL)
UNION ALL
SELECT submission_id, e.sheet, e.row, e.col, e.text, e.number, 'extra'
FROM (SELECT DISTINCT submission_id FROM v_claims), (VALUES
  ('Rate & Revenue', 5, 2, 'AED 612.40', NULL), ('Rate & Revenue', 9, 4, NULL, 77),
  ('Notes', 1, 1, 'Prepared by', NULL), ('Notes', 2, 2, NULL, 7)) e(sheet, row, col, text, number)""")
view("v_looks", """
SELECT *, number IS NOT NULL OR regexp_full_match(trim(text),
  '(AED )?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?%?') AS figure FROM v_wcells""")

view("v_nodes", f"""
SELECT 'R-' || user_id AS run_id, event_id AS seq,
  ({lit(values.NODE_ORDER)})[CAST(event_id % 5 AS INTEGER) + 1] AS node,
  CASE WHEN event_type = 'purchase' THEN 'exit' ELSE 'enter' END AS phase,
  CASE WHEN event_type = 'click' THEN 'running' WHEN event_id % 11 = 0 THEN 'halted'
    WHEN event_id % 13 = 0 THEN 'rejected' ELSE 'ok' END AS outcome,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS duration_ms,
  CASE WHEN event_type = 'purchase' THEN event_id % 3 ELSE 0 END AS model_calls
FROM events WHERE event_type IN ('click', 'purchase')""")
view("v_level", """
SELECT *, CASE WHEN phase = 'enter' THEN before + 1 ELSE before END AS level,
  phase = 'exit' AND before = 0 AS orphan
FROM (SELECT *, total - step - least(0, coalesce(min(total) OVER (PARTITION BY run_id, node
    ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before
  FROM (SELECT *, sum(step) OVER (PARTITION BY run_id, node ORDER BY seq) AS total
    FROM (SELECT *, CASE WHEN phase = 'enter' THEN 1 ELSE -1 END AS step FROM v_nodes)))""")
view("v_paired", """
SELECT run_id, node, seq, coalesce(exit_seq, -1) AS exit_seq,
  CASE WHEN exit_seq IS NULL THEN 'entered' ELSE o END AS outcome,
  CASE WHEN exit_seq IS NULL THEN 0 ELSE d END AS duration_ms,
  CASE WHEN exit_seq IS NULL THEN 0 ELSE m END AS model_calls
FROM (SELECT *, CASE WHEN nphase = 'exit' THEN nseq END AS exit_seq FROM (
  SELECT *, lead(phase) OVER w AS nphase, lead(seq) OVER w AS nseq, lead(outcome) OVER w AS o,
    lead(duration_ms) OVER w AS d, lead(model_calls) OVER w AS m
  FROM v_level WHERE NOT orphan WINDOW w AS (PARTITION BY run_id, node, level ORDER BY seq))
  WHERE phase = 'enter')
UNION ALL SELECT run_id, node, seq, seq, outcome, duration_ms, model_calls FROM v_level WHERE orphan""")
view("v_line", """
SELECT *, CAST(sum(duration_ms) OVER w AS BIGINT) AS end_ms,
  CAST(sum(greatest(duration_ms, 400)) OVER w AS BIGINT) AS display_end_ms,
  CAST(sum(model_calls) OVER w AS BIGINT) AS upto
FROM v_paired WINDOW w AS (PARTITION BY run_id ORDER BY seq)""")
view("v_calls", f"""
SELECT *, ({lit(['mapping', 'resolution', 'narrative', 'reviewer_assist', 'critic'])})
    [CAST(seq % 5 AS INTEGER) + 1] AS agent,
  row_number() OVER (PARTITION BY run_id ORDER BY seq) AS call_no
FROM (SELECT 'R-' || user_id AS run_id, event_id AS seq, user_id,
  event_id % 900 + 100 AS input_tokens, event_id % 300 AS output_tokens,
  event_id % 50 AS cache_read_tokens, CAST(floor(value * 10) AS BIGINT) AS duration_ms,
  event_id % 17 = 0 AS failed FROM events WHERE event_type = 'view')""")
view("v_open", """
SELECT run_id, node, latest FROM (SELECT run_id, node, min(seq) AS first, max(seq) AS latest FROM v_line
  GROUP BY ALL HAVING count(*) FILTER (exit_seq >= 0) = 0)
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY first DESC) = 1""")
view("v_attr", """
SELECT c.run_id, c.seq, c.agent, c.duration_ms, l.seq AS node_seq, coalesce(c.node,
    CASE WHEN c.agent = 'reviewer_assist' THEN 'review' ELSE 'unattributed' END) AS node,
  l.end_ms - l.duration_ms AS start_ms, l.display_end_ms - greatest(l.duration_ms, 400) AS display_start_ms
FROM (SELECT c.*, coalesce(l.seq, o.latest) AS at, coalesce(l.node, o.node) AS node FROM v_calls c
    LEFT JOIN v_line l ON l.run_id = c.run_id AND c.call_no > l.upto - l.model_calls AND c.call_no <= l.upto
    LEFT JOIN v_open o ON o.run_id = c.run_id) c
LEFT JOIN v_line l ON l.run_id = c.run_id AND l.seq = c.at""")
view("v_route", f"""
SELECT 'R-' || user_id AS run_id, event_id AS seq,
  ({lit(values.NODE_ORDER)})[CAST(event_id % 5 AS INTEGER) + 1] AS node,
  ({lit(['mapping', 'resolution', 'narrative'])})[CAST(event_id % 3 AS INTEGER) + 1] AS agent,
  CASE WHEN event_id % 9 = 0 THEN 'refused_budget' WHEN event_id % 10 = 0 THEN 'skipped'
    ELSE 'granted' END AS disposition, event_id % 10 <> 0 AS needed
FROM events WHERE event_type IN ('error', 'signup', 'view')""")
view("v_usage", """
SELECT run_id, user_id, agent, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM v_calls GROUP BY ALL""")
view("v_cost", """
SELECT *, CASE WHEN user_id % 4 <> 3 THEN t // 1000 + CASE WHEN t % 1000 > 500
    OR (t % 1000 = 500 AND (t // 1000) % 2 = 1) THEN 1 ELSE 0 END END AS units
FROM (SELECT *, input_tokens * 30 + output_tokens * 150 + cache_read_tokens * 3 AS t FROM v_usage)""")

# landed files: hotels without a fault, with misprints, with a file set that is sent back, with a faulty workbook
view("v_lhot", """
SELECT submission_id, hotel_no, hotel_no % 4 AS g, CASE WHEN hotel_no % 4 = 2 THEN 1 + (hotel_no // 4) % 8 ELSE 0 END AS fault
FROM v_hotels""")
view("v_lprint", """
SELECT * EXCLUDE (line), CAST(1 + (line - 1) // 30 AS INTEGER) AS page, CAST(1 + (line - 1) % 30 AS INTEGER) AS row_no,
  k % 83 = 0 OR k % 89 = 0 OR k % 101 = 0 OR k % 67 = 0 OR room_nights <> nights * rooms AS bad
FROM (SELECT t.* EXCLUDE (rooms, adults), t.period AS month, 'pms_' || t.period || '.pdf' AS file, c.copy,
    CAST(rooms * nights_in AS BIGINT) AS room_nights_month,
    CAST(CASE WHEN NOT arrives AND k % 53 = 0 THEN rooms + 1 ELSE rooms END AS INTEGER) AS rooms,
    CAST(CASE WHEN NOT arrives AND k % 43 = 0 THEN adults + 1 ELSE adults END AS INTEGER) AS adults,
    row_number() OVER (PARTITION BY submission_id, t.period ORDER BY arrival_date, order_no, copy) AS line
  FROM (SELECT *, CASE WHEN CAST(submission_id[3:] AS INTEGER) % 4 = 1 THEN order_no ELSE 1 END AS k FROM v_touch
    WHERE kind = 'month' AND period <= '2001-08') t
  JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR t.k % 71 = 0 WHERE t.arrives OR t.nights_in > 0)""")
view("v_lgood", "SELECT * FROM v_lprint WHERE NOT bad")
view("v_lsingle", "SELECT * FROM v_lprint WHERE copy = 1")
view("v_lextracted", extracted("v_lgood"))
view("v_lprinted", f"""
SELECT submission_id, month, check_name, code, CASE
    WHEN check_name = 'day_use' AND m = 6 THEN NULL
    WHEN check_name = 'total_guests' AND m = 7 THEN NULL
    ELSE value + CASE WHEN check_name = 'sold' AND m = 3 THEN 1 WHEN check_name = 'cancelled' AND m = 4 THEN 1
      WHEN check_name = 'guests' AND code = 'DE' AND m = 5 THEN 2 ELSE 0 END END AS value
FROM (SELECT *, CASE WHEN CAST(submission_id[3:] AS INTEGER) % 4 = 1 THEN CAST(month[6:7] AS INTEGER) ELSE 1 END AS m
  FROM ({extracted('v_lsingle')}))""")
view("v_ldiffer", """
SELECT coalesce(e.submission_id, p.submission_id) AS submission_id, coalesce(e.month, p.month) AS month,
  coalesce(e.check_name, p.check_name) AS check_name, coalesce(e.code, p.code) AS code
FROM v_lextracted e FULL JOIN v_lprinted p USING (submission_id, month, check_name, code)
WHERE (p.submission_id IS NOT NULL AND p.value IS NULL) OR coalesce(p.value, 0) <> coalesce(e.value, 0)""")
view("v_lclaims", "SELECT * FROM v_claims WHERE (row + col) % 31 <> 0 AND coalesce(value_key, '') <> 'XK'")
for _name in ("v_pairs", "v_explained", "v_class", "v_allfind", "v_find"):
    view("v_l" + _name[2:], re.sub(r"\bv_(claims|pairs|explained|class|allfind|find)\b", r"v_l\1", VIEWS[_name]))
view("v_lupstream", """
SELECT submission_id, 0 AS stage, 'D-RNS-02' AS clause, 'pdf' AS source_kind FROM v_lprint WHERE bad
UNION ALL SELECT submission_id, 0, 'D-QUAL-07', 'pdf' FROM v_lgood GROUP BY submission_id, reservation_id, file HAVING count(*) > 1
UNION ALL SELECT submission_id, 0, 'D-RNS-03', 'pdf' FROM v_lgood GROUP BY submission_id, reservation_id HAVING count(DISTINCT adults) > 1
UNION ALL SELECT submission_id, 0, CASE WHEN check_name = 'sold' THEN 'D-RNS-04' WHEN check_name LIKE '%guests' THEN 'D-NAT-07'
  ELSE 'D-QUAL-01' END, 'pdf' FROM v_ldiffer
UNION ALL SELECT submission_id, 1, 'D-XLS-06', 'not_reached' FROM v_lhot, (VALUES (1), (2), (3)) WHERE g = 3
UNION ALL SELECT DISTINCT submission_id, 1, 'D-NAT-12', 'not_reached' FROM v_claims JOIN v_lhot USING (submission_id) WHERE g = 3 AND value_key = 'XK'
UNION ALL SELECT submission_id, 1, 'D-XLS-05', 'not_reached' FROM v_lhot WHERE hotel_no % 8 = 3""")
view("v_lreconciled", """
SELECT submission_id FROM v_lhot WHERE fault = 0 AND submission_id NOT IN (SELECT submission_id FROM v_lupstream)""")
view("v_lfound", """
SELECT submission_id, stage, clause, source_kind, 'V7' AS variance_class, 'blocking' AS severity FROM v_lupstream
  JOIN v_lhot USING (submission_id) WHERE fault = 0
UNION ALL
SELECT submission_id, 2, clause, CASE WHEN computed IS NULL AND explaining IS NULL THEN 'not_reached'
    WHEN metric <> 'room_nights_available' AND (submission_id, period, coalesce(value_key, '*'), coalesce(explaining, 'BASELINE')) IN (
      SELECT (t.submission_id, t.period, unnest(['*', t.nationality_iso2]), q.ruleset_id) FROM v_touch t JOIN v_rules q
        ON list_contains(q.status_in, t.status) AND list_contains(q.rate_in, t.rate_code)) THEN 'pdf'
    WHEN metric IN ('room_nights_available', 'occupancy_pct') AND (submission_id, period) IN (
      SELECT (submission_id, period) FROM v_invp) THEN 'inventory'
    ELSE 'not_reached' END, variance_class, severity
FROM v_lfind JOIN v_lreconciled USING (submission_id)""")
view("v_faults", "SELECT submission_id, hotel_no, (hotel_no + 1) % 9 AS fault FROM v_hotels")
view("v_lproblems", """
SELECT submission_id, 'unreadable_file' AS problem, 'pms_2001-08.pdf' AS subject, 1 AS p FROM v_faults WHERE fault = 1
UNION ALL SELECT submission_id, 'unnamed_month', 'pms_draft.pdf', 2 FROM v_faults WHERE fault = 2
UNION ALL SELECT submission_id, 'foreign_month', '2031-01', 3 FROM v_faults WHERE fault = 3
UNION ALL SELECT submission_id, 'two_for_one_month', '1995-01', 4 FROM v_faults WHERE fault = 4
UNION ALL SELECT submission_id, 'missing_month', '2001-08', 5 FROM v_faults WHERE fault BETWEEN 2 AND 5
UNION ALL SELECT submission_id, 'workbook_period', 'claims_1994.xlsx', 6 FROM v_faults WHERE fault = 6
UNION ALL SELECT submission_id, 'hotel_mismatch', 'h-x', 7 FROM v_faults WHERE fault = 7 AND hotel_no % 10 <> 7
UNION ALL SELECT submission_id, 'unreadable_file', 'claims_1995.xlsx', 1 FROM v_faults WHERE fault = 8""")
REASON_CASE = """CASE problem WHEN 'unreadable_file' THEN 'unreadable_file' WHEN 'missing_month' THEN 'incomplete_file_set'
  WHEN 'hotel_mismatch' THEN 'hotel_mismatch' ELSE 'period_mismatch' END"""

# the same under another policy: its rulesets, a wider band, roundings raised
view("v_orules", rule_rows(other_policy().rules))
view("v_oclasses", rows(other_policy().class_rules, "variance_class, class_name, severity, proposes, escalates_to"))
for _name in ("v_sold", "v_guests", "v_values", "v_base", "v_perm", "v_pairs", "v_explained", "v_class", "v_allfind", "v_find"):
    view("v_o" + _name[2:], re.sub(
        r"\bv_(rules|classes|sold|guests|values|base|perm|pairs|explained|class|allfind|find)\b", r"v_o\1", VIEWS[_name]
    ).replace("0.10", OTHER_TOLERANCE))
