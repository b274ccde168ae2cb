"""Reports, labels, inventories and file sets."""

from pyspark.sql import functions as F

from staycheck import values
from staycheck.catalog.duck import REASON_CASE
from staycheck.catalog.registry import query
from staycheck.functions.text import normalise_key
from staycheck.operators import checks, intake, labels
from staycheck.operators import reports as rp
from staycheck.plans import adapters as a


def broken_reservations(spark, sf):
    k = F.col("order_no")
    return a.reservations(spark, sf).withColumns({
        "guest_ref": F.when(k % 97 == 0, "DOE/JANE").otherwise(F.col("guest_ref")),
        "nationality_iso2": F.when(k % 73 == 0, "de").otherwise(F.col("nationality_iso2")),
        "adults": F.when(k % 89 == 0, 0).otherwise(F.col("adults")),
        "room_nights": F.when(k % 61 == 0, F.col("room_nights") + 1)
        .otherwise(F.col("room_nights")),
        "departure_date": F.when(k % 59 == 0, F.date_sub("arrival_date", 1))
        .otherwise(F.col("departure_date")),
        "status": F.when(k % 47 == 0, "RESERVED").otherwise(F.col("status")),
    })


@query("prj_02_reservation_checks", """
SELECT * FROM (SELECT order_no, array_to_string([x FOR x IN [
  CASE WHEN order_no % 97 = 0 THEN 'guest_ref' END, CASE WHEN order_no % 73 = 0 THEN 'nationality' END,
  CASE WHEN order_no % 89 = 0 THEN 'adults' END,
  CASE WHEN order_no % 59 = 0 THEN 'departure_before_arrival' END,
  CASE WHEN order_no % 59 = 0 THEN 'nights' END, CASE WHEN order_no % 61 = 0 THEN 'room_nights' END,
  CASE WHEN order_no % 47 = 0 THEN 'status' END] IF x IS NOT NULL], ',') AS problems FROM v_res)
WHERE problems <> ''""")
def _(spark, sf):
    return checks.check_reservations(broken_reservations(spark, sf)).select(
        "order_no", F.concat_ws(",", "problems").alias("problems"))


@query("flt_02_opaque_refs", """
SELECT submission_id, count(*) FILTER (order_no % 97 <> 0) AS opaque,
  count(*) FILTER (order_no % 97 = 0) AS named FROM v_res GROUP BY ALL""")
def _(spark, sf):
    from staycheck.functions.text import opaque_ref
    ok = opaque_ref(F.col("guest_ref"))
    return broken_reservations(spark, sf).groupBy("submission_id").agg(
        F.count_if(ok).alias("opaque"), F.count_if(~ok).alias("named"))


@query("prj_03_inventory_checks", """
SELECT submission_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day(day) = 11 AND month(day) = 2
  THEN 'out_of_order_above_total,printed_availability' ELSE 'printed_availability' END AS problems
FROM v_inv WHERE (day(day) = 11 AND month(day) = 2) OR day(day) = 29""")
def _(spark, sf):
    inv = a.inventory(spark, sf).withColumn(
        "rooms_available", F.col("rooms_total") - F.col("rooms_out_of_order")
        + F.when(F.dayofmonth("day") == 29, 1).otherwise(0))
    inv = inv.withColumn("rooms_out_of_order", F.when(
        (F.dayofmonth("day") == 11) & (F.month("day") == 2), F.col("rooms_total") + 1
    ).otherwise(F.col("rooms_out_of_order")))
    return checks.check_inventory(inv).select(
        "submission_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.concat_ws(",", "problems").alias("problems"))


@query("prj_03_unreadable_inventory", """
SELECT submission_id, strftime(day, '%Y-%m-%d') AS day,
  CASE WHEN day(day) = 13 THEN 'rooms_out_of_order' WHEN day(day) = 14 THEN 'rooms_total' ELSE '' END AS unreadable,
  CASE WHEN day(day) = 13 THEN 'unreadable,rooms_out_of_order' WHEN day(day) = 14 THEN 'unreadable,rooms_total'
    ELSE 'rooms_out_of_order' END AS problems
FROM v_inv WHERE day(day) IN (13, 14, 15)""")
def _(spark, sf):
    """Figures that are no number, too long or not there."""
    from staycheck.sources.readers import parse_inventory
    day = F.dayofmonth("day")
    raw = a.inventory(spark, sf).select("submission_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(
        day == 14, "99999999999").otherwise(F.col("rooms_total").cast("string")).alias("rooms_total"), F.when(
        day == 13, "x").when(day == 15, "").otherwise(F.col("rooms_out_of_order").cast("string")).alias(
        "rooms_out_of_order"), F.lit(None).cast("string").alias("rooms_available"))
    return checks.check_inventory(parse_inventory(raw)).select(
        "submission_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.concat_ws(",", "unreadable").alias("unreadable"),
        F.concat_ws(",", "problems").alias("problems"))


@query("ag_12_merge_split", """
WITH p AS (SELECT submission_id, reservation_id, rooms, order_no FROM v_res),
twice AS (SELECT *, rooms AS shown FROM p UNION ALL SELECT *, CASE WHEN order_no % 10 = 3 THEN NULL
  WHEN order_no % 10 = 4 THEN rooms + 1 ELSE rooms END FROM p)
SELECT submission_id, reservation_id, count(*) AS printings, CASE WHEN order_no % 10 IN (3, 4) THEN 'rooms' ELSE '' END
  AS conflicts FROM twice GROUP BY submission_id, reservation_id, order_no""")
def _(spark, sf):
    """Printings that agree, disagree, or of which one lacks the figure."""
    rows = a.reservations(spark, sf).withColumns({"file": F.lit("a"), "page": F.lit(1), "row_no": F.lit(1)})
    last = F.regexp_extract("reservation_id", "[0-9]$", 0).cast("int")
    again = rows.withColumn("file", F.lit("b")).withColumn("rooms", F.when(last == 3, None).when(
        last == 4, F.col("rooms") + 1).otherwise(F.col("rooms")))
    good, bad = rp.split_merged(rp.merge_reports(rows.unionByName(again)))
    return good.withColumn("conflicts", F.array().cast("array<string>")).unionByName(bad, allowMissingColumns=True).select(
        "submission_id", "reservation_id", "printings", F.concat_ws(",", "conflicts").alias("conflicts"))


@query("prj_04_printed_crosschecks", """
SELECT reservation_id, month, copy, array_to_string([x FOR x IN [
  CASE WHEN order_no % 83 = 0 THEN 'arrival' END,
  CASE WHEN order_no % 83 = 0 AND nights = 0 THEN 'departure' END,
  CASE WHEN order_no % 89 = 0 THEN 'adults' END,
  CASE WHEN order_no % 83 <> 0 AND order_no % 67 = 0 THEN 'printed_nights' END,
  CASE WHEN order_no % 83 <> 0 AND room_nights <> nights * rooms THEN 'printed_room_nights' END]
  IF x IS NOT NULL], ',') AS defects FROM v_print""")
def _(spark, sf):
    cells = a.printed_cells(a.printed_rows(spark, sf)).withColumn("stray_words", F.lit(0))
    return checks.parse_printed(cells).select(
        "reservation_id", F.substring("file", 5, 7).alias("month"), "copy",
        F.concat_ws(",", "defects").alias("defects"))


@query("prj_05_day_use_departure", """
SELECT reservation_id, month, copy, strftime(departure_date, '%Y-%m-%d') AS departure
FROM v_print WHERE NOT (nights = 0 AND order_no % 83 = 0)""")
def _(spark, sf):
    cells = a.printed_cells(a.printed_rows(spark, sf)).withColumn("stray_words", F.lit(0))
    return checks.parse_printed(cells).filter("departure_date is not null").select(
        "reservation_id", F.substring("file", 5, 7).alias("month"), "copy",
        F.date_format("departure_date", "yyyy-MM-dd").alias("departure"))


@query("sc_02_03_strict_parsing", """
SELECT submission_id, count(*) FILTER (order_no % 83 <> 0) AS dates,
  count(*) FILTER (order_no % 89 <> 0) AS numbers FROM v_print GROUP BY ALL""")
def _(spark, sf):
    from staycheck.functions.text import parse_iso_date, parse_whole_number
    cells = a.printed_cells(a.printed_rows(spark, sf))
    return cells.groupBy("submission_id").agg(
        F.count(parse_iso_date(F.col("arrival"))).alias("dates"),
        F.count(parse_whole_number(F.col("adults"))).alias("numbers"))


@query("sc_01_normalise_key", "SELECT custkey, alias_key FROM v_labels")
def _(spark, sf):
    return a.customer_labels(spark, sf).select(
        "custkey", normalise_key(F.col("label")).alias("alias_key"))


def _countries(spark):
    return labels.alias_index(labels.committed_labels(spark)).filter("kind = 'country'")


@query("jn_01_normalise_labels", """
SELECT custkey, label, coalesce(code, '?') AS code FROM v_labels LEFT JOIN v_alias USING (alias_key)""")
def _(spark, sf):
    return labels.normalise_labels(
        a.customer_labels(spark, sf), "label", _countries(spark), "code").select(
        "custkey", "label", F.coalesce("code", F.lit("?")).alias("code"))


@query("jn_01_unmapped_labels", """
SELECT submission_id, label, alias_key, count(*) AS uses FROM v_labels
WHERE alias_key NOT IN (SELECT alias_key FROM v_alias) GROUP BY ALL""")
def _(spark, sf):
    df = labels.normalise_labels(a.customer_labels(spark, sf), "label", _countries(spark), "code")
    return labels.unmapped(df, "label", "code", ["submission_id"])


@query("src_07_alias_use", """
SELECT code, alias_key, count(custkey) AS uses FROM v_alias LEFT JOIN v_labels USING (alias_key)
GROUP BY ALL""")
def _(spark, sf):
    used = labels.normalise_labels(
        a.customer_labels(spark, sf), "label", _countries(spark), "code")
    uses = used.groupBy("alias_key").agg(F.count("*").alias("uses"))
    return _countries(spark).join(uses, "alias_key", "left").select(
        "code", "alias_key", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("ag_29_alias_collisions", """
SELECT alias_key, count(DISTINCT code) AS codes, min(code) AS first_code, max(code) AS last_code
FROM (SELECT trim(regexp_replace(lower(p_name), '[^0-9a-z ]+', '', 'g')) AS alias_key,
  p_brand AS code FROM part) GROUP BY ALL HAVING count(DISTINCT code) > 1""")
def _(spark, sf):
    rows = a.table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_brand").alias("code"), F.col("p_name").alias("label"))
    return labels.alias_collisions(labels.alias_index(rows)).drop("kind")


@query("sc_08_official_names", """
SELECT code, alias_key AS name FROM (SELECT DISTINCT p_brand AS code,
  trim(regexp_replace(lower(p_name), '[^0-9a-z ]+', '', 'g')) AS alias_key FROM part)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(alias_key) DESC, alias_key DESC) = 1""")
def _(spark, sf):
    rows = a.table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_brand").alias("code"), F.col("p_name").alias("label"))
    return labels.official_names(labels.alias_index(rows)).select("code", "name")


@query("jn_01_kinds", """
SELECT custkey, label, country, rate FROM v_kind_labels
LEFT JOIN (SELECT alias_key, min(code) AS country FROM v_kinds WHERE kind = 'country' GROUP BY 1
  HAVING count(DISTINCT code) = 1) USING (alias_key)
LEFT JOIN (SELECT alias_key, min(code) AS rate FROM v_kinds WHERE kind = 'rate code' GROUP BY 1
  HAVING count(DISTINCT code) = 1) USING (alias_key)""")
def _(spark, sf):
    """Every customer's own label as a country and as a rate code."""
    index = labels.alias_index(labels.committed_labels(spark))
    df = labels.normalise_labels(a.two_kind_labels(spark, sf), "label", index, "country", "country").drop("alias_key")
    return labels.normalise_labels(df, "label", index, "rate", "rate code").drop("alias_key")


@query("sc_09_similarity", """
WITH n AS (SELECT code, alias_key AS name FROM v_alias QUALIFY row_number() OVER (
  PARTITION BY code ORDER BY length(alias_key) DESC, alias_key DESC) = 1)
SELECT label, code, r.score AS similarity
FROM v_shortlist JOIN v_asked USING (label) JOIN n USING (code) JOIN v_ratio r ON r.k = v_asked.k AND r.alias = n.name""")
def _(spark, sf):
    """How close each unmatched label is to the longest alias of every code it is offered."""
    names = labels.official_names(_countries(spark)).select("code", "name")
    return _shortlist(spark, sf).join(names, "code").select(
        "label", "code", labels.matching_ratio(normalise_key(F.col("label")), F.col("name")).alias("similarity"))


@query("jn_20_candidates", """SELECT * FROM v_shortlist""")
def _(spark, sf):
    """Labels as they come and with words left out or moved."""
    return _shortlist(spark, sf)


def _shortlist(spark, sf):
    said = a.customer_labels(spark, sf).select("label").union(a.moved_labels(spark, sf).select("label"))
    unmatched = labels.normalise_labels(said, "label", _countries(spark), "code").filter("code is null")
    return labels.candidates(unmatched, "label", _countries(spark))


@query("fl_02_best_candidate", """SELECT * FROM v_shortlist WHERE rank = 1""")
def _(spark, sf):
    return _shortlist(spark, sf).filter("rank = 1")


@query("wn_11_ambiguous_labels", """
SELECT label, gap FROM (SELECT label, rank, abs(score - lead(score) OVER (
  PARTITION BY label ORDER BY rank)) AS gap FROM v_shortlist) WHERE rank = 1 AND gap < 0.05""")
def _(spark, sf):
    return labels.ambiguous(_shortlist(spark, sf))


@query("jn_07_inventory_gaps", """
SELECT d.submission_id, strftime(d.day, '%Y-%m-%d') AS day FROM (
  SELECT submission_id, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31',
    INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT submission_id FROM v_inv)) d
LEFT JOIN v_inv i ON i.submission_id = d.submission_id AND i.day = d.day WHERE i.day IS NULL""")
def _(spark, sf):
    return checks.inventory_gaps(a.inventory(spark, sf), a.declared_periods(spark, sf)).select(
        "submission_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("prj_24_25_page_layout", """
SELECT submission_id, file, page, array_to_string([x FOR x IN [
  CASE WHEN n % 7 = 0 THEN 'header' END, CASE WHEN n % 11 = 0 THEN 'property' END]
  IF x IS NOT NULL], ',') AS problems
FROM (SELECT DISTINCT submission_id, file, page, page * 3 + CAST(file[10:11] AS INTEGER) AS n
  FROM v_print) WHERE n % 7 = 0 OR n % 11 = 0""")
def _(spark, sf):
    return rp.check_layout(a.page_texts(a.printed_rows(spark, sf))).select(
        "submission_id", "file", "page", F.concat_ws(",", "problems").alias("problems"))


@query("jn_19_words_in_bands", """
SELECT submission_id, coalesce(band, '?') AS band, CAST(sum(words) AS BIGINT) AS words FROM (
  SELECT submission_id, unnest(['reservation_id', 'guest_ref', 'nationality', 'arrival', 'departure',
    'nights', 'rooms', 'adults', CASE WHEN order_no % 101 = 0 THEN NULL ELSE 'children' END,
    'room_nights_total', 'room_nights_month', 'rate_code', 'status']) AS band,
    unnest([1, 1, 1, 1, CASE WHEN nights = '0' OR departure LIKE '-%' THEN 4 ELSE 1 END, 1, 1, 1, 1,
      1, 1, 1, CASE WHEN status = 'Cancelled' THEN 1 ELSE 2 END]) AS words FROM v_cells
  UNION ALL SELECT submission_id, 'reservation_id', 1 FROM v_cells WHERE row_no = 1)
GROUP BY ALL""")
def _(spark, sf):
    words = a.report_words(a.printed_cells(a.printed_rows(spark, sf)))
    return rp.assign_bands(words).groupBy(
        "submission_id", F.coalesce("band", F.lit("?")).alias("band")).agg(
        F.count("*").alias("words"))


@query("wn_05_data_rows", """
SELECT submission_id, file, page, row_no, reservation_id, guest_ref, nationality, arrival,
  departure, nights, rooms, adults,
  CASE WHEN order_no % 101 = 0 THEN '' ELSE children END AS children, room_nights_total,
  room_nights_month, rate_code, status,
  CAST(CASE WHEN order_no % 101 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stray_words,
  CAST(60 + 15 * row_no AS DOUBLE) AS top, CAST(69 + 15 * row_no AS DOUBLE) AS bottom
FROM v_cells WHERE order_no % 101 <> 0
UNION ALL SELECT submission_id, file, page, row_no, reservation_id, guest_ref, nationality, arrival,
  departure, nights, rooms, adults, '', room_nights_total, room_nights_month, rate_code, status,
  1, CAST(60 + 15 * row_no AS DOUBLE), CAST(69 + 15 * row_no AS DOUBLE)
FROM v_cells WHERE order_no % 101 = 0""")
def _(spark, sf):
    # a word left of every column would otherwise be read as the first cell of its line
    words = a.report_words(a.printed_cells(a.printed_rows(spark, sf))).withColumns({
        "x0": F.when(F.col("x0") < 10, F.col("x0") + 800).otherwise(F.col("x0")),
        "x1": F.when(F.col("x1") < 10, F.col("x1") + 800).otherwise(F.col("x1"))})
    return rp.data_lines(words, a.ID_PATTERN)


@query("sc_12_page_columns", """
SELECT submission_id, file, page,
  string_agg(CASE WHEN order_no % 101 = 0 THEN children || ' ' ELSE '' END || reservation_id || ' '
    || guest_ref || ' ' || nationality || ' ' || arrival || ' ' || departure || ' ' || nights,
    chr(10) ORDER BY row_no) || chr(10) || 'Page' AS left_text,
  string_agg(rooms || ' ' || adults || ' ' || CASE WHEN order_no % 101 = 0 THEN ''
    ELSE children || ' ' END || room_nights_total || ' ' || room_nights_month || ' ' || rate_code
    || ' ' || status, chr(10) ORDER BY row_no) AS right_text
FROM v_cells GROUP BY ALL""")
def _(spark, sf):
    return rp.page_columns(a.report_words(a.printed_cells(a.printed_rows(spark, sf))))


@query("prj_23_printed_totals", """
SELECT submission_id, month, check_name, code, CAST(value AS DOUBLE) AS value FROM v_printed
WHERE NOT (check_name = 'guests' AND value IS NULL)""")
def _(spark, sf):
    parsed = rp.parse_totals(a.totals_blocks(a.printed_rows(spark, sf)))
    return rp.printed_checks(parsed).withColumn("value", F.col("value").cast("double"))


@query("prj_23_missing_totals", """
SELECT DISTINCT submission_id, month, 'total_guests' AS missing FROM v_print WHERE month LIKE '%-07'""")
def _(spark, sf):
    parsed = rp.parse_totals(a.totals_blocks(a.printed_rows(spark, sf)))
    return parsed.select("submission_id", "month", F.explode("missing").alias("missing"))


@query("sc_13_guest_maps", """
SELECT submission_id, code, CAST(sum(value) AS BIGINT) AS guests FROM v_printed
WHERE check_name = 'guests' GROUP BY ALL""")
def _(spark, sf):
    parsed = rp.parse_totals(a.totals_blocks(a.printed_rows(spark, sf)))
    return parsed.select("submission_id", F.explode("guests").alias("code", "n")).groupBy(
        "submission_id", "code").agg(F.sum("n").alias("guests"))


@query("jn_14_reconcile_totals", """
SELECT coalesce(e.submission_id, p.submission_id) AS submission_id,
  coalesce(e.month, p.month) AS month, coalesce(e.check_name, p.check_name) AS check_name,
  coalesce(e.code, p.code) AS code, CAST(p.value AS DOUBLE) AS printed,
  CAST(e.value AS DOUBLE) AS extracted
FROM v_extracted e FULL JOIN v_printed p ON e.submission_id = p.submission_id
  AND e.month = p.month AND e.check_name = p.check_name AND e.code = p.code
WHERE (p.submission_id IS NOT NULL AND p.value IS NULL)
  OR coalesce(p.value, 0) <> coalesce(e.value, 0)""")
def _(spark, sf):
    rows = a.printed_rows(spark, sf)
    out = rp.reconcile_totals(rows, rp.parse_totals(a.totals_blocks(rows)))
    return out.withColumns({c: F.col(c).cast("double") for c in ("printed", "extracted")})


@query("ag_13_exclusions", """
SELECT submission_id, month, check_name, value FROM v_extracted
WHERE check_name IN ('cancelled', 'no_show', 'house_use', 'day_use')""")
def _(spark, sf):
    return _extracted(spark, sf, "cancelled", "no_show", "house_use", "day_use")


@query("ag_14_listed_sums", """
SELECT submission_id, month, check_name, value FROM v_extracted
WHERE check_name IN ('listed_rows', 'listed_room_nights')""")
def _(spark, sf):
    return _extracted(spark, sf, "listed_rows", "listed_room_nights")


def _extracted(spark, sf, *names):
    return rp.extracted_totals(a.printed_rows(spark, sf)).filter(
        F.col("check_name").isin(*names)).drop("code")


@query("ag_15_page_subtotals", """
SELECT submission_id, file, page, count(*) AS listed,
  CAST(sum(CASE WHEN status IN ('CHECKED_OUT', 'IN_HOUSE') AND rate_code <> 'HOUSE'
    THEN room_nights ELSE 0 END) AS BIGINT) AS room_nights,
  CAST(sum(CASE WHEN status IN ('CHECKED_OUT', 'IN_HOUSE') AND rate_code <> 'HOUSE'
    THEN room_nights_month ELSE 0 END) AS BIGINT) AS room_nights_month
FROM v_print GROUP BY ALL""")
def _(spark, sf):
    return rp.page_subtotals(a.printed_rows(spark, sf))


@query("ag_10_duplicates_in_report", """
SELECT submission_id, reservation_id, file, count(*) AS rows,
  string_agg(page || ':' || row_no, ' ' ORDER BY page, row_no) AS refs FROM v_print
GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    out = checks.duplicate_ids(a.printed_rows(spark, sf),
                               ["submission_id", "reservation_id", "file"], ["page", "row_no"])
    refs = F.array_join(F.transform("refs", lambda x: F.concat_ws(":", x["page"], x["row_no"])), " ")
    return out.select("submission_id", "reservation_id", "file", "rows", refs.alias("refs"))


@query("ag_11_duplicate_ids", """
SELECT l_orderkey, l_linenumber, count(*) AS rows,
  array_to_string(list(l_partkey ORDER BY l_partkey, l_suppkey, l_quantity)[1:3], ' ') AS refs,
  greatest(count(*) - 3, 0) AS more FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    out = checks.duplicate_ids(
        a.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_suppkey", "l_quantity"])
    refs = F.array_join(F.transform("refs", lambda x: x["l_partkey"].cast("string")), " ")
    return out.select("l_orderkey", "l_linenumber", "rows", refs.alias("refs"), "more")


@query("fl_03_bounded_listing", """
SELECT submission_id, array_to_string(list(reservation_id ORDER BY reservation_id)[1:5], ' ')
  AS shown, greatest(count(*) - 5, 0) AS more
FROM (SELECT DISTINCT submission_id, reservation_id FROM v_print WHERE copy = 2) GROUP BY ALL""")
def _(spark, sf):
    twice = a.printed_rows(spark, sf).filter("copy = 2").select(
        "submission_id", "reservation_id").distinct()
    return checks.bounded_listing(twice, ["submission_id"], "reservation_id", 5).withColumn(
        "shown", F.concat_ws(" ", "shown"))


@query("ag_12_merge_reports", """
SELECT submission_id, reservation_id, arg_min(file, file || lpad(page::VARCHAR, 6, '0')
    || lpad(row_no::VARCHAR, 4, '0')) AS file, count(*) AS printings,
  CASE WHEN min(rooms) <> max(rooms) THEN 'rooms' ELSE '' END AS conflicts
FROM v_print GROUP BY ALL""")
def _(spark, sf):
    return rp.merge_reports(a.printed_rows(spark, sf)).select(
        "submission_id", "reservation_id", "file", "printings",
        F.concat_ws(",", "conflicts").alias("conflicts"))


@query("wn_04_earliest_citation", """
SELECT submission_id, reservation_id, file, page, row_no FROM v_print QUALIFY row_number() OVER (
  PARTITION BY submission_id, reservation_id ORDER BY file, page, row_no) = 1""")
def _(spark, sf):
    return rp.merge_reports(a.printed_rows(spark, sf)).select(
        "submission_id", "reservation_id", "file", "page", "row_no")


@query("ag_16_extraction_summary", """
WITH d AS (SELECT DISTINCT submission_id FROM (
  SELECT coalesce(e.submission_id, p.submission_id) AS submission_id FROM v_extracted e
  FULL JOIN v_printed p ON e.submission_id = p.submission_id AND e.month = p.month
    AND e.check_name = p.check_name AND e.code = p.code
  WHERE (p.submission_id IS NOT NULL AND p.value IS NULL)
    OR coalesce(p.value, 0) <> coalesce(e.value, 0)))
SELECT p.submission_id, count(DISTINCT reservation_id) AS records,
  count(DISTINCT CASE WHEN copy = 2 THEN reservation_id END) AS duplicates,
  count(DISTINCT (file, page)) AS pages, count(DISTINCT file) AS files,
  bool_and(d.submission_id IS NULL) AS matched
FROM v_print p LEFT JOIN d USING (submission_id) GROUP BY ALL""")
def _(spark, sf):
    rows = a.printed_rows(spark, sf)
    off = rp.reconcile_totals(rows, rp.parse_totals(a.totals_blocks(rows)))
    return rp.extraction_summary(rows, off)


@query("ag_27_edge_quotas", """
WITH q(edge, need) AS (VALUES ('month_spanning', 25), ('comp', 25), ('house', 25), ('day_use', 30),
  ('arriving_before_period', 12), ('in_house_at_period_end', 8), ('multi_room', 100),
  ('nationalities', 20)),
w AS (SELECT submission_id,
  count(*) FILTER (nights > 0 AND date_trunc('month', arrival_date)
    < date_trunc('month', departure_date - 1)) AS month_spanning,
  count(*) FILTER (rate_code = 'COMP') AS comp, count(*) FILTER (rate_code = 'HOUSE') AS house,
  count(*) FILTER (nights = 0) AS day_use,
  count(*) FILTER (arrival_date < DATE '1996-01-01') AS arriving_before_period,
  count(*) FILTER (status = 'IN_HOUSE' AND departure_date > DATE '2000-12-31')
    AS in_house_at_period_end,
  count(*) FILTER (rooms > 1) AS multi_room, count(DISTINCT nationality_iso2) AS nationalities
  FROM v_res GROUP BY ALL)
SELECT submission_id, edge, have, need, have >= need AS met FROM (
  UNPIVOT w ON COLUMNS(* EXCLUDE submission_id) INTO NAME edge VALUE have) JOIN q USING (edge)""")
def _(spark, sf):
    return checks.edge_quotas(a.reservations(spark, sf), F.lit("1996-01-01").cast("date"),
                              F.lit("2000-12-31").cast("date"))


@query("src_05_discover_files", """
SELECT submission_id, role, coalesce(month, '') AS month, count(*) AS files FROM (
  SELECT f.submission_id, CASE WHEN f.name LIKE 'pms%' THEN 'report' WHEN f.name LIKE 'claims%'
    THEN 'workbook' ELSE 'inventory' END AS role,
    CASE WHEN f.name LIKE 'pms%' THEN r.month ELSE '1995-Q1' END AS month
  FROM v_files f LEFT JOIN v_reports r USING (doc_id)) GROUP BY ALL""")
def _(spark, sf):
    return intake.with_role(a.submission_files(spark, sf)).groupBy(
        "submission_id", "role", F.coalesce("month", F.lit("")).alias("month")).agg(
        F.count("*").alias("files"))


@query("src_06_file_digests", """
SELECT doc_id, name, 'sha256:' || sha256(content) AS sha256,
  CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM v_files""")
def _(spark, sf):
    return intake.file_digests(a.submission_files(spark, sf)).select(
        "doc_id", "name", "sha256", "bytes")


@query("sc_07_sha256", """
SELECT sha256, count(*) AS files FROM (SELECT sha256(text) AS sha256 FROM documents) GROUP BY ALL""")
def _(spark, sf):
    return a.table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256")).groupBy(
        "sha256").agg(F.count("*").alias("files"))


def _months(spark, sf):
    return a.declared_periods(spark, sf).filter("length(period) = 7 and period not like '%Q%'"
                                                ).withColumnRenamed("period", "month")


def _problems(spark, sf):
    return intake.file_set_problems(a.submission_files(spark, sf), _months(spark, sf))


@query("jn_08_file_set", "SELECT * FROM v_fileprob")
def _(spark, sf):
    return _problems(spark, sf)


@query("so_04_missing_months", """
SELECT submission_id, subject AS month FROM v_fileprob WHERE problem = 'missing_month'""")
def _(spark, sf):
    from staycheck.functions.text import month_of_report
    filed = a.submission_files(spark, sf).select(
        "submission_id", month_of_report(F.col("name")).alias("month"))
    return _months(spark, sf).select("submission_id", "month").exceptAll(
        _months(spark, sf).select("submission_id", "month").join(
            filed, ["submission_id", "month"], "left_semi"))


def _landed_problems(spark, sf):
    return intake.landing_problems(a.landed_files(spark, sf, every=True), a.landed_declared(spark, sf), _months(spark, sf),
                                   a.landed_inventory(spark, sf, every=True))


@query("jn_08_landed_files", "SELECT submission_id, problem, subject FROM v_lproblems")
def _(spark, sf):
    """Every problem of the landed file sets, of each kind there is."""
    return _landed_problems(spark, sf)


@query("fl_04_first_rejection", f"""
SELECT submission_id, {REASON_CASE} AS rejection_reason, problem, subject FROM v_lproblems
QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY p, subject) = 1""")
def _(spark, sf):
    return intake.first_rejection(_landed_problems(spark, sf))


@query("jn_13_foreign_hotels", """
SELECT DISTINCT submission_id, 'h-x' AS hotel_id FROM v_inv WHERE day = DATE '1999-05-05'""")
def _(spark, sf):
    inv = a.inventory(spark, sf).withColumn("hotel_id", F.when(
        F.col("day") == F.lit("1999-05-05").cast("date"), "h-x").otherwise(F.col("hotel_id")))
    declared = a.hotels(spark, sf).withColumn("hotel_id", F.col("submission_id"))
    return intake.foreign_hotels(inv, declared)


@query("jn_13_cover_identity", """
SELECT submission_id, field, stated, expected FROM (
  SELECT custkey, 'C-' || custkey AS submission_id,
    unnest(['property code', 'reporting period']) AS field,
    unnest([CASE WHEN custkey % 13 = 0 THEN 'h-zz' ELSE ' ' || lower(submission_id) END,
      CASE WHEN custkey % 17 = 0 THEN '1996-Q1' ELSE '1995-q1 ' END]) AS stated,
    unnest([submission_id, '1995-Q1']) AS expected FROM v_labels)
WHERE lower(trim(stated)) <> lower(expected)""")
def _(spark, sf):
    k = F.col("custkey")
    base = a.customer_labels(spark, sf).select(
        F.concat(F.lit("C-"), k.cast("string")).alias("submission_id"),
        F.col("submission_id").alias("hotel_id"), F.lit("1995-Q1").alias("period"), "custkey")
    cover = base.select(
        "submission_id",
        F.when(k % 13 == 0, "h-zz").otherwise(F.concat(F.lit(" "), F.lower("hotel_id")))
        .alias("stated_hotel"),
        F.when(k % 17 == 0, "1996-Q1").otherwise("1995-q1 ").alias("stated_period"))
    return intake.identity_mismatches(cover, base.drop("custkey"))


@query("prj_32_staged_names", """
SELECT doc_id, CASE WHEN name LIKE '%.pdf' THEN 'pms_' ||
    nullif(regexp_extract(name, '[0-9]{4}-(0[1-9]|1[0-2])'), '') || '.pdf'
  WHEN name LIKE '%.xlsx' THEN 'claims_1995-Q1.xlsx' ELSE 'inventory_1995-Q1.csv' END AS target
FROM v_files""")
def _(spark, sf):
    files = a.submission_files(spark, sf).withColumn("period", F.lit("1995-Q1"))
    return intake.staged_names(files).select("doc_id", "target")


@query("prj_32_contested_names", """
SELECT submission_id, target, count(*) AS files, min(name) AS first_name FROM (
  SELECT submission_id, name, CASE WHEN name LIKE '%.pdf' THEN 'pms_' ||
    nullif(regexp_extract(name, '[0-9]{4}-(0[1-9]|1[0-2])'), '') || '.pdf'
  WHEN name LIKE '%.xlsx' THEN 'claims_1995-Q1.xlsx' ELSE 'inventory_1995-Q1.csv' END AS target
  FROM v_files) WHERE target IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    files = a.submission_files(spark, sf).withColumn("period", F.lit("1995-Q1"))
    return intake.contested_targets(intake.staged_names(files))
