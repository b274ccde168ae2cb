"""The driver's tables seen as domain tables.

A hotel is a block of 150 customers, so hotels grow in number, not in size, with the data. Errors
are planted by fixed rules on ids, so every check has something to find at every scale.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions import periods
from staycheck.functions.cells import cell_ref, column_letters
from staycheck.functions.keys import render_key
from staycheck.functions.text import transpose_digits
from staycheck.operators.ranking import ranked
from staycheck.operators.reports import extracted_totals, listed_rows
from staycheck.session import spread
from staycheck.sources.policy import Policy, committed_document, parse_policy

NATIONALITIES = [
    "AE", "AU", "CH", "CN", "CZ", "DE", "EG", "ES", "FR", "GB", "IN", "IT", "JP",
    "KR", "KZ", "NL", "NO", "PH", "PK", "PL", "RU", "SA", "SE", "TR", "US",
]
RATES = ["BAR", "CORP", "GOV", "OTA", "GROUP", "COMP", "HOUSE"]
# ids here carry twelve digits, since a table may hold more than 99,999 stays a quarter
ID_PATTERN = "^RES-[0-9]{4}Q[1-4]-[0-9]{12}$"
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hotel(custkey: str):
    return F.concat(F.lit("H-"), F.expr(f"{custkey} div 150").cast("string"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    arrival = F.to_date("o_orderdate")
    nights = (k % 9).cast("int")
    rooms = (F.lit(1) + c % 3).cast("int")
    urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    rid = F.concat(F.lit("RES-"), F.date_format(arrival, "yyyy"), F.lit("Q"), F.quarter(arrival),
                   F.lit("-"), F.lpad(k.cast("string"), 12, "0"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        hotel("o_custkey").alias("submission_id"),
        hotel("o_custkey").alias("hotel_id"),
        rid.alias("reservation_id"),
        F.concat(F.lit("g_"), F.substring(F.sha2(k.cast("string"), 256), 1, 16)).alias("guest_ref"),
        F.get(F.array(*[F.lit(n) for n in NATIONALITIES]), F.col("c_nationkey"))
        .alias("nationality_iso2"),
        (F.lit(1) + k % 4).cast("int").alias("adults"),
        (c % 3).cast("int").alias("children"),
        rooms.alias("rooms"),
        nights.alias("nights"),
        (nights * rooms).alias("room_nights"),
        arrival.alias("arrival_date"),
        F.date_add(arrival, nights).alias("departure_date"),
        F.when(F.col("o_orderstatus") == "F", "CHECKED_OUT")
        .when(F.col("o_orderstatus") == "O", "IN_HOUSE")
        .when(urgent, "CANCELLED").otherwise("NO_SHOW").alias("status"),
        F.get(F.array(*[F.lit(r) for r in RATES]), (k % 7).cast("int")).alias("rate_code"),
        k.alias("order_no"),
    )


def reservation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations with the report row they are printed on: 30 rows a page, one report a month."""
    res = reservations(spark, sf_dir).withColumn(
        "file", F.concat(F.lit("pms_"), periods.month_label(F.col("arrival_date")), F.lit(".pdf")))
    res = res.withColumn("_part", F.expr("order_no div 1000000"))
    out = ranked(res, ["submission_id", "file"], ["arrival_date", "_part"], ["order_no"], "_line")
    return out.withColumns({
        "page": (F.floor((F.col("_line") - 1) / 30) + 1).cast("int"),
        "row_no": ((F.col("_line") - 1) % 30 + 1).cast("int"),
    }).drop("_line", "_part")


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        hotel("c_custkey").alias("submission_id"), F.expr("c_custkey div 150").alias("hotel_no")
    ).distinct()


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hotel and day. Hotels ending in 7 filed none; hotels ending in 3 were closed in
    February 1997; hotels ending in 5 miss one day of March 1998."""
    days = F.sequence(F.lit(FIRST_MONTH).cast("date"), F.lit("2001-08-31").cast("date"))
    filed = spread(hotels(spark, sf_dir).filter("hotel_no % 10 <> 7"), "submission_id")
    rows = filed.withColumn("day", F.explode(days))
    month = periods.month_label(F.col("day"))
    no = F.col("hotel_no")
    rows = rows.filter(~((no % 10 == 3) & (month == "1997-02")) & ~(
        (no % 10 == 5) & (F.col("day") == F.lit("1998-03-17").cast("date"))))
    out_of_order = F.when(F.dayofmonth("day").between(10, 12), 3).otherwise(0)
    return rows.select(
        "submission_id", F.col("submission_id").alias("hotel_id"), "day",
        (F.lit(40) + no % 10).cast("int").alias("rooms_total"),
        out_of_order.cast("int").alias("rooms_out_of_order"),
        F.concat(F.lit("inventory_"), periods.quarter_label(F.col("day")), F.lit(".csv"))
        .alias("file"),
        (F.datediff("day", F.trunc("day", "quarter")) + 1).cast("int").alias("row_no"),
    )


def declared_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of the span with the quarter and year it belongs to, per submission."""
    months = F.sequence(F.lit(FIRST_MONTH).cast("date"), F.lit(LAST_MONTH).cast("date"),
                        F.expr("interval 1 month"))
    labels = F.array_distinct(F.flatten(F.transform(months, periods.periods_of_month)))
    return spread(hotels(spark, sf_dir), "submission_id").select("submission_id", F.explode(labels).alias("period"))


ALTERNATIVE = {
    "room_nights_sold": "P-MONTH-ARRIVAL", "room_nights_available": "P-OOO-INCLUDED",
    "occupancy_pct": "P-OCC-DENOM-ROOMS", "guests_by_nationality": "P-CHILDREN-EXCLUDED",
}
METRIC_NO = {"room_nights_sold": 1, "room_nights_available": 2, "occupancy_pct": 3,
             "guests_by_nationality": 4}


def plant(metric_no, value_key) :
    """Which error, if any, is planted on a claim: 0..11 by a rule on its key."""
    extra = F.when(value_key.isNotNull(),
                   F.ascii(value_key) + F.ascii(F.right(value_key, F.lit(1))) * 2).otherwise(0)
    return (F.ascii(F.right("period", F.lit(1))) + F.ascii(F.substring("period", 4, 1)) * 3
            + hotel_no() * 5 + metric_no * 7 + extra) % 12


def hotel_no():
    return F.substring("submission_id", 3, 20).cast("int")


def period_position():
    year = F.substring("period", 1, 4).cast("int") - 1995
    kind = periods.period_kind(F.col("period"))
    return (
        F.when(kind == "month", year * 12 + F.substring("period", 6, 2).cast("int") - 1)
        .when(kind == "quarter", 100 + year * 4 + F.substring("period", 7, 1).cast("int") - 1)
        .otherwise(200 + year)
    )


def claims(metrics: DataFrame) -> DataFrame:
    """A workbook's claims: the computed figures with planted errors, in their cells.

    Hotels ending in 4 or 9 filed correct figures."""
    metric_no = F.create_map(*[F.lit(x) for kv in METRIC_NO.items() for x in kv])[F.col("metric")]
    wanted = F.create_map(*[F.lit(x) for kv in ALTERNATIVE.items() for x in kv])[F.col("metric")]

    def under(ruleset):
        return F.get(F.filter("permuted", lambda p: p["ruleset_id"] == ruleset), F.lit(0))["value"]

    v, h = F.col("computed"), F.col("h")
    occ = F.col("metric") == "occupancy_pct"
    filed = (
        F.when(hotel_no() % 5 == 4, v)
        .when(v.isNull() & F.col("nv_reason").isNull(), F.when(h == 5, under("P-HOUSE-INCLUDED")))
        .when(v.isNull(), F.when(h == 5, under("P-HOUSE-INCLUDED")).when(h == 6, F.lit(50)))
        .when(h == 0, v + 1)
        .when(h == 1, F.coalesce(transpose_digits(v), v))
        .when(h == 2, F.coalesce(under(wanted), v))
        .when(h == 3, None)
        .when((h == 4) & occ, v + F.lit("0.05").cast("decimal(4,2)"))
        .otherwise(v)
    ).cast("decimal(38,10)")
    stated = metrics.withColumn("h", plant(metric_no, F.col("value_key"))).withColumn(
        "filed", filed)
    orphan = (F.col("metric") == "room_nights_sold") & (F.col("h") == 7)
    entries = F.array(
        F.when(F.col("filed").isNotNull(), F.struct(
            "metric", "dimension", "value_key", F.col("filed").alias("value"))),
        F.when(orphan, F.struct(
            F.lit("guests_by_nationality").alias("metric"), F.lit(values.DIMENSION)
            .alias("dimension"), F.lit("XK").alias("value_key"),
            F.lit(5).cast("decimal(38,10)").alias("value"))))
    rows = stated.select("submission_id", "period", F.explode(entries).alias("e")).filter("e is not null").select(
        "submission_id", "period", "e.metric", "e.dimension", "e.value_key", "e.value")
    return in_cells(rows)


def in_cells(rows: DataFrame) -> DataFrame:
    """Figures (submission_id, metric, period, dimension, value_key, value) in the cells of a workbook."""
    nat = F.array_position(F.array(*[F.lit(n) for n in NATIONALITIES + ["XK"]]),
                           F.col("value_key"))
    by_nat = F.col("metric") == "guests_by_nationality"
    number = F.create_map(*[F.lit(x) for kv in METRIC_NO.items() for x in kv])[F.col("metric")]
    row = F.when(by_nat, F.lit(4) + nat).otherwise(F.lit(5) + F.col("_at")).cast("int")
    col = F.when(by_nat, F.lit(2) + F.col("_at")).otherwise(number + 1).cast("int")
    # a step each: written out inside one another the place would be worked out some forty times a cell
    placed = rows.withColumn("_at", period_position()).withColumns({"row": row, "col": col})
    return placed.select(
        "submission_id", "metric", "period", "dimension", "value_key",
        render_key(F.col("metric"), F.col("period"), F.col("dimension"), F.col("value_key"))
        .alias("metric_key"), "value",
        F.when(by_nat, "Nationality").otherwise("Occupancy").alias("sheet"),
        "row", "col", cell_ref(F.col("row"), F.col("col")).alias("cell"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: one per event, on the finding its id points at."""
    e = table(spark, sf_dir, "events")
    k, t = F.col("event_id"), F.col("event_type")
    amend = t == "purchase"
    return e.select(
        F.concat(F.lit("H-"), F.expr("user_id div 15").cast("string")).alias("submission_id"),
        F.format_string("F-%04d", (k % 500 + 1).cast("int")).alias("finding_id"),
        F.when(amend, "amend").when(t == "view", "reject").otherwise("accept").alias("decision"),
        F.when(k % 37 == 0, " ").when(k % 41 == 0, "a\nb").otherwise(
            F.concat(F.lit("officer "), F.col("user_id").cast("string"))).alias("reviewer"),
        F.when(amend & (k % 5 != 0), F.when(k % 7 == 0, "NaN").otherwise(
            (k % 100).cast("string"))).when(k % 43 == 0, "1").alias("amended_value"),
        k.alias("seq"))


def citations(findings: DataFrame) -> DataFrame:
    """Three citations per finding, some of which point at nothing."""
    n = F.substring("finding_id", 3, 4).cast("int")
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def entry(kind, when, **fields):
        cols = {"file": none_s, "page": none_i, "row_start": none_i, "row_end": none_i,
                "sheet": none_s, "cell": none_s, "clause": none_s, "policy_version": none_s}
        cols.update(fields)
        return F.when(when, F.struct(kind.alias("kind"), *[c.alias(k) for k, c in cols.items()]))

    rows = entry(F.col("source_kind"), F.col("source_kind") != "not_reached",
                 file=F.col("source_file"), page=F.col("source_page"),
                 row_start=F.col("source_row_start"),
                 row_end=F.col("source_row_end") + F.when(n % 5 == 0, 1).otherwise(0))
    cells = entry(F.lit("excel"), F.col("cell").isNotNull(),
                  sheet=F.when(n % 7 == 0, "Notes").otherwise(F.col("sheet")), cell=F.col("cell"))
    clause = entry(F.lit("clause"), F.lit(True),
                   clause=F.when(n % 11 == 0, "D-XXX-99").otherwise(F.col("clause")),
                   policy_version=F.when(n % 13 == 0, "1.0.0").otherwise(
                       F.lit(values.POLICY_VERSION)))
    return findings.select("submission_id", "finding_id", F.explode(
        F.array_compact(F.array(rows, cells, clause))).alias("c")).select(
        "submission_id", "finding_id", "c.*")


def narratives(findings: DataFrame) -> DataFrame:
    n = F.substring("finding_id", 3, 4).cast("int")
    return findings.select(
        "submission_id", "finding_id",
        F.when(n % 17 == 0, "F-0000").otherwise(F.col("finding_id")).alias("echoed_id"),
        F.when(n % 3 == 0, F.col("explaining_permutation")).when(n % 19 == 0, "P-OOO-INCLUDED")
        .alias("cites_permutation"),
        F.repeat(F.concat(F.col("metric_key"), F.lit(" ")), F.when(n % 23 == 0, 30).otherwise(1))
        .alias("sentence"),
        (n % 29 != 0).alias("grounded"), (n % 31 == 0).alias("leaks_a_number"),
        (n % 37 == 0).alias("names_an_unassigned_cause"),
        (n % 41 == 0).alias("reads_as_an_accusation"))


def printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the monthly reports. A stay over a month end is on both reports; every 71st
    reservation is printed twice on one report, and every 53rd prints another room count on the
    later report."""
    return laid_out(listed_rows(reservations(spark, sf_dir)).withColumn("k", F.col("order_no")))


def laid_out(listed: DataFrame) -> DataFrame:
    """Listed rows (with order_no and k, the number that errors are planted by) on pages of 30 rows."""
    k = F.col("k")
    later = ~F.col("arrives")
    rows = listed.withColumn("copy", F.explode(F.sequence(
        F.lit(1), F.when(k % 71 == 0, 2).otherwise(1)))).withColumns({
            "_part": F.expr("order_no div 1000000"),
            "rooms": F.when(later & (k % 53 == 0), F.col("rooms") + 1).otherwise(F.col("rooms"))})
    out = ranked(rows, ["submission_id", "file"], ["arrival_date", "_part"], ["order_no", "copy"],
                 "_line")
    return out.withColumns({
        "page": (F.floor((F.col("_line") - 1) / 30) + 1).cast("int"),
        "row_no": ((F.col("_line") - 1) % 30 + 1).cast("int"),
    }).drop("_line", "_part")


def printed_cells(rows: DataFrame) -> DataFrame:
    """The same rows as the text a report shows, with a few misprints."""
    k = F.col("k")
    title = F.initcap(F.regexp_replace(F.lower("status"), "_", " "))
    return rows.select(
        "submission_id", "file", "page", "row_no", "order_no", "k", "copy", "reservation_id",
        "guest_ref", F.col("nationality_iso2").alias("nationality"),
        F.when(k % 83 == 0, F.date_format("arrival_date", "dd/MM/yyyy"))
        .otherwise(F.date_format("arrival_date", "yyyy-MM-dd")).alias("arrival"),
        F.when(F.col("nights") == 0, "- day use -")
        .otherwise(F.date_format("departure_date", "yyyy-MM-dd")).alias("departure"),
        (F.col("nights") + F.when(k % 67 == 0, 1).otherwise(0)).cast("string").alias("nights"),
        F.col("rooms").cast("string").alias("rooms"),
        F.when(k % 89 == 0, "two").otherwise(F.col("adults").cast("string")).alias("adults"),
        F.col("children").cast("string").alias("children"),
        F.col("room_nights").cast("string").alias("room_nights_total"),
        F.col("room_nights_month").cast("string").alias("room_nights_month"),
        "rate_code", title.alias("status"))


CENTRES = {
    "reservation_id": 64.0, "guest_ref": 162.0, "nationality": 244.0, "arrival": 289.0,
    "departure": 330.0, "nights": 414.0, "rooms": 446.0, "adults": 472.0, "children": 498.0,
    "room_nights_total": 546.0, "room_nights_month": 598.0, "rate_code": 616.0, "status": 665.0,
}


def report_words(cells: DataFrame) -> DataFrame:
    """Words with positions. Every 101st reservation has its child count outside all columns, and
    every page ends with a subtotal line that is not a data row."""
    def placed(field, x, step):
        return F.transform(F.split(field, " "), lambda t, i: F.struct(
            t.alias("text"), (x + i * step - 2).alias("x0"), (x + i * step + 2).alias("x1"),
            (F.col("row_no") * 15 + 60.0).alias("top")))

    stray = F.when(F.col("k") % 101 == 0, 5.0).otherwise(CENTRES["children"])
    words = [placed(field, stray if field == "children" else F.lit(centre),
                    9 if field == "departure" else 23) for field, centre in CENTRES.items()]
    subtotal = F.when(F.col("row_no") == 1, F.array(F.struct(
        F.lit("Page").alias("text"), F.lit(30.0).alias("x0"), F.lit(50.0).alias("x1"),
        F.lit(560.0).alias("top")))).otherwise(F.array())
    return cells.select("submission_id", "file", "page", F.explode(
        F.concat(*words, subtotal)).alias("w")).select(
        "submission_id", "file", "page", "w.*", (F.col("w.top") + 9).alias("bottom"))


def page_texts(rows: DataFrame) -> DataFrame:
    """Heading and column header of each page; every 7th page lost a column, every 11th the
    property code."""
    n = F.col("page") * 3 + F.substring("file", 10, 2).cast("int")
    header = " ".join(b[3] for b in values.BANDS)
    prop = F.when(n % 11 == 0, "Propty").otherwise("Property")
    return rows.select("submission_id", "file", "page").distinct().select(
        "submission_id", "file", "page", F.concat(
            F.lit("Reservation Detail Report | "), prop, F.lit(" "), F.col("submission_id"),
            F.lit("\n  "), F.when(n % 7 == 0, header.replace(" RN Month", "")).otherwise(
                header.replace(" ", "  ")), F.lit("\nRES-1 ...")).alias("text"))


def totals_blocks(rows: DataFrame) -> DataFrame:
    """The grand-total text of each report, computed from single printings, with planted misprints
    by month number."""
    return printed_totals(extracted_totals(rows.filter("copy = 1")), F.substring("month", 6, 2).cast("int"))


def printed_totals(ours: DataFrame, month_no: Column) -> DataFrame:
    """month_no: the number that misprints are planted by."""
    value = F.col("value") + (
        F.when((F.col("check_name") == "sold") & (month_no == 3), 1)
        .when((F.col("check_name") == "cancelled") & (month_no == 4), 1)
        .when((F.col("check_name") == "guests") & (F.col("code") == "DE") & (month_no == 5), 2)
        .otherwise(0))
    ours = ours.withColumn("value", value)
    wide = ours.withColumn("n", month_no).groupBy("submission_id", "month", "n").agg(
        *[F.max(F.when(F.col("check_name") == c, F.col("value"))).alias(c) for c in (
            "sold", "listed_rows", "listed_room_nights", "cancelled", "no_show", "house_use",
            "day_use", "total_guests")],
        F.array_join(F.array_sort(F.collect_list(F.when(
            F.col("check_name") == "guests", F.concat_ws(" ", "code", "value")))), "\n")
        .alias("codes"))
    month_no = F.col("n")
    left = F.format_string(
        "Room nights sold %d\nRoom nights available %d\nOccupancy 50.00%%\n"
        "Sum of the RN Month column over all %d listed rows: %d\n"
        "Rows listed but excluded from the total: %d cancelled, %d no-show, %d house\nuse%s\n"
        "Complimentary rooms are included.",
        F.col("sold"), F.col("sold") * 2, F.col("listed_rows"), F.col("listed_room_nights"),
        F.col("cancelled"), F.col("no_show"), F.col("house_use"),
        F.when(month_no == 6, "").otherwise(F.concat(
            F.lit(", "), F.col("day_use").cast("string"), F.lit(" day use (zero room-nights)"))))
    right = F.concat(F.lit("Guests by nationality\n"), "codes", F.lit("\n"), F.when(
        month_no == 7, "").otherwise(F.concat(F.lit("Total guests "), F.col("total_guests"))))
    return wide.select("submission_id", "month", left.alias("left_text"), right.alias("right_text"))


LABEL_NAMES = {c[0]: (c[1], c[2]) for c in values.COUNTRIES}


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nationality label per customer, spelled in different ways; some are in no lookup."""
    names = [LABEL_NAMES[n][1] for n in NATIONALITIES]
    alpha3 = [LABEL_NAMES[n][0] for n in NATIONALITIES]
    k = F.col("c_custkey")

    def pick(items):
        return F.get(F.array(*[F.lit(i) for i in items]), F.col("c_nationkey"))

    name = pick(names)
    label = (
        F.when(k % 6 == 0, F.upper(name)).when(k % 6 == 1, pick(alpha3))
        .when(k % 6 == 2, F.concat(F.lit(" "), F.lower(name), F.lit("  ")))
        .when(k % 6 == 3, F.concat(F.regexp_replace(name, " ", "  "), F.lit(".")))
        .when(k % 6 == 4, pick(NATIONALITIES))
        .when(k % 36 == 5, "Austrlia").when(k % 18 == 5, "Mongolia").when(k % 18 == 11, F.substring(name, 2, 60))
        .otherwise(name))
    return table(spark, sf_dir, "customer").select(
        hotel("c_custkey").alias("submission_id"), k.alias("custkey"), label.alias("label"))


TWO_KIND_LABELS = ("HU", "CO", "Block", "hu ", "Comp.", "AE", "nowhere")


def two_kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's own label; each of 7 in 35 says what is read one way as a country and another as a
    rate code."""
    said = F.get(F.array(*[F.lit(x) for x in TWO_KIND_LABELS]), (F.col("custkey") % 35).cast("int"))
    return customer_labels(spark, sf_dir).select("custkey", F.coalesce(said, "label").alias("label"))


def moved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's label; those of two words and more with the last word first, then without it, for some."""
    k, name = F.col("custkey"), F.trim("label")
    last, head = F.regexp_extract(name, " ([^ ]+)$", 1), F.regexp_replace(name, " +[^ ]+$", "")
    moved = F.when((k % 4 == 0) & (last != ""), F.concat(last, F.lit(" "), head)).when(
        (k % 4 == 1) & (last != ""), head).when(k % 24 == 3, "Arabia").when(k % 24 == 7, "Republic of Korea")
    return customer_labels(spark, sf_dir).select("custkey", F.coalesce(moved, "label").alias("label"))


# What is planted in a hotel's landed files: nothing, misprints, a file set that is sent back, a workbook with
# faults; and in file sets, by their number, one fault of each kind.
FILE_FAULTS = ("none", "unreadable_file", "unnamed_month", "foreign_month", "two_for_one_month", "missing_month",
               "workbook_period", "hotel_mismatch", "no_workbook")
LANDED_PERIOD = "1995"


def landed_fault(every: bool = False) -> Column:
    """Number of the fault (FILE_FAULTS) of a hotel's file set: in all hotels in turn, or in every fourth only."""
    n = hotel_no()
    return ((n + 1) % 9) if every else F.when(n % 4 == 2, 1 + F.expr("cast(substring(submission_id, 3, 20) as int) div 4") % 8).otherwise(0)


def landed_files(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """A report for each month, a workbook and an inventory per hotel, with the fault of the hotel's number."""
    fault = landed_fault(every)
    months = declared_periods(spark, sf_dir).filter(periods.period_kind(F.col("period")) == "month")
    last = F.col("period") == LAST_MONTH[:7]
    name = (F.when((fault == 2) & last, "pms_draft.pdf").when((fault == 3) & last, "pms_2031-01.pdf")
            .when((fault == 4) & last, "pms_1995-01.pdf").otherwise(F.concat(F.lit("pms_"), "period", F.lit(".pdf"))))
    reports = months.filter(~((fault == 5) & last)).select("submission_id", name.alias("name"), F.when(
        (fault == 1) & last, "").otherwise("report").alias("content"))
    book = F.when(fault == 6, "claims_1994.xlsx").otherwise(f"claims_{LANDED_PERIOD}.xlsx")
    books = hotels(spark, sf_dir).filter(fault != 8).select("submission_id", book.alias("name"), F.lit("book").alias("content"))
    days = hotels(spark, sf_dir).select("submission_id", F.lit(f"inventory_{LANDED_PERIOD}.csv").alias("name"), F.lit("days").alias("content"))
    return reports.unionByName(books).unionByName(days)


def landed_inventory(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    other = (landed_fault(every) == 7) & (F.dayofmonth("day") == 5)
    return inventory(spark, sf_dir).withColumn("hotel_id", F.when(other, "h-x").otherwise(F.col("hotel_id")))


def landed_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotels(spark, sf_dir).select("submission_id", F.col("submission_id").alias("hotel_id"), F.lit(LANDED_PERIOD).alias("period"))


def landed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the declared months. Misprints are in every fourth hotel, and of every 43rd reservation
    the later report prints another adult."""
    planted = hotel_no() % 4 == 1
    listed = listed_rows(reservations(spark, sf_dir)).filter(F.col("month").between(FIRST_MONTH[:7], LAST_MONTH[:7]))
    listed = listed.withColumn("k", F.when(planted, F.col("order_no")).otherwise(1))
    return laid_out(listed.withColumn("adults", F.col("adults") + F.when(~F.col("arrives") & (F.col("k") % 43 == 0), 1).otherwise(0)))


def landed_words(rows: DataFrame) -> DataFrame:
    """Words of report rows; one outside all columns stands at the end of its line."""
    out = F.col("x0") < 10
    return report_words(printed_cells(rows)).withColumns({
        c: F.when(out, F.col(c) + 800).otherwise(F.col(c)) for c in ("x0", "x1")})


def landed_totals(rows: DataFrame) -> DataFrame:
    ours = extracted_totals(rows.filter("copy = 1"))
    return printed_totals(ours, F.when(hotel_no() % 4 == 1, F.substring("month", 6, 2).cast("int")).otherwise(1))


def landed_workbook(filed: DataFrame, period: str = LANDED_PERIOD, uncached: Column | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, blocks, cover) of claims in their cells. In every fourth hotel a label nobody knows, a sheet
    nobody mapped and two blocks that can't be read; in half of those a cover sheet of another property."""
    faulty = hotel_no() % 4 == 3
    filed = filed.filter(faulty | (F.coalesce("value_key", F.lit("")) != "XK"))
    cells = workbook_cells(filed, uncached).filter(faulty | (F.col("sheet") != "Notes"))
    used = filed.groupBy("submission_id").agg(
        F.max(F.when(F.col("dimension").isNull(), F.col("row"))).cast("string").alias("r"),
        column_letters(F.max(F.when(F.col("dimension").isNotNull(), F.col("col")))).alias("c"))

    def block(no, sheet, metric, value, period, when=None, dim=None, labels_=None, total=None):
        names = ("block_id", "sheet", "metric", "orientation", "value_range", "period_label_range",
                 "named_dimension", "dimension_label_range", "dimension_total_range")
        across = "periods_across_columns" if dim else "periods_down_rows"
        parts = [F.lit(x).cast("string") if not isinstance(x, Column) else x
                 for x in (no, sheet, metric, across, value, period, dim, labels_, total)]
        return F.when(F.lit(True) if when is None else when, F.struct(*[x.alias(n) for x, n in zip(parts, names)]))

    r, c = F.col("r"), F.col("c")
    blocks = [block(str(i), "Occupancy", metric, F.concat(F.lit(f"{col}5:{col}"), r), F.concat(F.lit("A5:A"), r), r.isNotNull())
              for i, (metric, col) in enumerate(zip(METRIC_NO, "BCD"), 1)]
    blocks += [
        block("4", "Nationality", "guests_by_nationality", F.concat(F.lit("B5:"), c, F.lit("30")), F.concat(F.lit("B4:"), c, F.lit("4")),
              c.isNotNull(), values.DIMENSION, "A5:A30", F.concat(F.lit("B31:"), c, F.lit("31"))),
        block("5", "Rate & Revenue", "average_daily_rate", "B5:D5", "B4:D4"),
        block("6", "Occupancy", "mystery", "E5:E8", "A5:A8", faulty), block("7", "Missing", "occupancy_pct", "B5:B8", "A5:A8", faulty)]
    mapped = used.select("submission_id", F.explode(F.array_compact(F.array(*blocks))).alias("b")).select("submission_id", "b.*")
    cover = used.select("submission_id", F.lit("Cover").alias("sheet"), F.when(hotel_no() % 8 == 3, "h-zz").otherwise(
        F.col("submission_id")).alias("stated_hotel"), F.lit(period).alias("stated_period"))
    return cells, mapped, cover


def submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submitted files; the name follows from the document id."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 100

    def month(i):
        return F.date_format(F.add_months(F.lit(FIRST_MONTH).cast("date"), i.cast("int")), "yyyy-MM")

    name = (
        F.when(n == 17, "pms_draft.pdf")
        .when(n < 80, F.concat(F.lit("pms_"), month(n), F.lit(".pdf")))
        .when(n < 85, F.concat(F.lit("pms_"), month(n - 80), F.lit(".pdf")))
        .when(n < 90, F.concat(F.lit("pms_2002-0"), (n - 84).cast("string"), F.lit(".pdf")))
        .when(n < 95, F.concat(F.lit("pms_report"), n.cast("string"), F.lit("_final.pdf")))
        .when(n == 95, "claims_1995-Q1.xlsx").otherwise("inventory_1995-Q1.csv"))
    return d.select(F.concat(F.lit("H-"), F.expr("doc_id div 100").cast("string"))
                    .alias("submission_id"), name.alias("name"), F.col("text").alias("content"),
                    "doc_id")


MONTH_WORDS = [names[0].capitalize() for names in values.MONTH_NAMES]


def workbook_cells(filed: DataFrame, uncached: Column | None = None) -> DataFrame:
    """The claims laid out as a workbook: figures written in different ways, labels, totals, a
    sheet of rates and a sheet nobody mapped. uncached: which figures are formulas without a value."""
    none, r, c, v = F.lit(None), F.col("row"), F.col("col"), F.col("value")
    uncached = (r + c) % 31 == 0 if uncached is None else uncached
    occ = F.col("metric") == "occupancy_pct"
    mix = (r + c) % 5
    text = (
        F.when(uncached, "=SUM(B2:B4)")
        .when(occ, F.when(r % 3 == 1, F.concat(v.cast("decimal(18,2)").cast("string"), F.lit("%"))))
        .when(mix == 0, F.format_number(v, 0))
        .when(mix == 1, F.concat(F.lit("AED "), v.cast("bigint").cast("string"))))
    fraction = occ & (r % 3 == 0)
    number = F.when(text.isNull(), F.when(fraction, v / 100).otherwise(v)).cast("decimal(38,10)")
    sheet = ["submission_id", "sheet"]
    cols = [*sheet, "row", "col", "text", "number", "number_format", "value_type"]

    def cells(df, row, col, text, number, fmt=F.lit("General")):
        return df.select(*sheet, row.cast("int").alias("row"), col.cast("int").alias("col"),
                         text.cast("string").alias("text"),
                         number.cast("decimal(38,10)").alias("number"), fmt.alias("number_format"),
                         F.when(number.isNotNull(), "number").otherwise("text").alias("value_type"))

    figures = cells(filed, r, c, text, number, F.when(fraction & text.isNull(), "0.00%")
                    .otherwise("General"))
    p = F.col("period")
    kind = periods.period_kind(p)
    word = F.get(F.array(*[F.lit(m) for m in MONTH_WORDS]),
                 F.substring(p, 6, 2).try_cast("int") - 1)
    label = (
        F.when(kind == "quarter", F.concat(p, F.lit(" total")))
        .when((kind == "month") & (period_position() % 3 == 0),
              F.concat(word, F.lit(" "), F.substring(p, 1, 4)))
        .otherwise(p))
    per = filed.select(*sheet, "period").distinct()
    down = F.col("sheet") == "Occupancy"
    pos = period_position()
    labels_ = cells(per, F.when(down, pos + 5).otherwise(4), F.when(down, 1).otherwise(pos + 2),
                    label, none)
    nat = filed.filter("value_key is not null")
    names = F.create_map(*[F.lit(x) for n in NATIONALITIES for x in (n, LABEL_NAMES[n][1])])
    dims = cells(nat.select(*sheet, "value_key", "row").distinct(), r, F.lit(1),
                 F.coalesce(names[F.col("value_key")], F.lit("Xanadu")), none)
    sums = nat.groupBy(*sheet, "period").agg(F.sum("value").alias("value"))
    totals = cells(sums, F.lit(31), pos + 2, none, v + F.when(pos % 9 == 0, 3).otherwise(0))
    subs = filed.select("submission_id").distinct()
    others = subs.selectExpr("submission_id", """stack(4,
        'Rate & Revenue', 5, 2, 'AED 612.40', cast(null as int),
        'Rate & Revenue', 9, 4, cast(null as string), 77,
        'Notes', 1, 1, 'Prepared by', cast(null as int),
        'Notes', 2, 2, cast(null as string), 7) as (sheet, row, col, text, number)""")
    others = cells(others, r, c, F.col("text"), F.col("number"))
    out = figures
    for part in (labels_, dims, totals, others):
        out = out.unionByName(part.select(*cols))
    return out


def mapping_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ranges hold which metric, per hotel; some hotels carry a broken block."""
    def block(no, sheet, metric, orientation, value, period, dim=None, labels_=None, total=None,
              when=None):
        s = F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(
            (no, sheet, metric, orientation, value, period, dim, labels_, total),
            ("block_id", "sheet", "metric", "orientation", "value_range", "period_label_range",
             "named_dimension", "dimension_label_range", "dimension_total_range"))])
        return s if when is None else F.when(when, s)

    n, down, across = F.col("hotel_no"), "periods_down_rows", "periods_across_columns"
    nat = "guests_by_nationality"
    blocks = F.array_compact(F.array(
        block("1", "Occupancy", "room_nights_sold", down, "B5:B211", "A5:A211"),
        block("2", "Occupancy", "room_nights_available", down, "C5:C211", "A5:A211"),
        block("3", "Occupancy", "occupancy_pct", down, "D5:D211", "A5:A211"),
        block("4", "Nationality", nat, across, "B5:GZ30", "B4:GZ4", values.DIMENSION, "A5:A30",
              "B31:GZ31"),
        block("5", "Rate & Revenue", "average_daily_rate", across, "B5:D5", "B4:D4"),
        block("6", "Occupancy", "mystery", down, "E5:E8", "A5:A8", when=n % 2 == 1),
        block("7", "Missing", "occupancy_pct", down, "B5:B8", "A5:A8", when=n % 3 == 0),
        block("8", "Occupancy", "occupancy_pct", down, "B5:C8", "A5:A8", when=n % 4 == 0),
        block("9", "Occupancy", "revenue", down, "$B$5", "A5:A8", when=n % 5 == 0),
        block("10", "Nationality", nat, across, "B5:C9", "B4:C4", when=n % 2 == 0),
        block("11", "Occupancy", "occupancy_pct", down, "D5:D999", "A5:A999", when=n % 3 == 1)))
    return hotels(spark, sf_dir).select("submission_id", F.explode(blocks).alias("b")).select(
        "submission_id", "b.*")


def _run_id():
    return F.concat(F.lit("R-"), F.col("user_id").cast("string"))


def node_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node entries (clicks) and exits (purchases) per run, in event order."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')")
    k = F.col("event_id")
    leave = F.col("event_type") == "purchase"
    nodes = F.array(*[F.lit(n) for n in values.NODE_ORDER])
    return e.select(
        _run_id().alias("run_id"), k.alias("seq"),
        F.get(nodes, (k % 5).cast("int")).alias("node"),
        F.when(leave, "exit").otherwise("enter").alias("phase"),
        F.when(~leave, "running").when(k % 11 == 0, "halted").when(k % 13 == 0, "rejected")
        .otherwise("ok").alias("outcome"),
        F.when(leave, F.floor(F.col("value") * 20)).otherwise(0).alias("duration_ms"),
        F.when(leave, k % 3).otherwise(0).alias("model_calls"),
        F.when(leave, k % 900).otherwise(0).alias("input_tokens"),
        F.when(leave, k % 300).otherwise(0).alias("output_tokens"))


def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in three have a verdict; the others are still going on."""
    return table(spark, sf_dir, "events").filter("user_id % 3 <> 0").select(_run_id().alias("run_id")).distinct()


AGENTS = ["mapping", "resolution", "narrative", "reviewer_assist", "critic"]


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls per run: every view event."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    k = F.col("event_id")
    tools = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(
        F.when((k + i) % 3 == 0, "list_sheets").otherwise("peek_headers").alias("name"),
        ((k + i) % 7 != 0).alias("allowed")))
    shape_ = F.concat(
        F.lit('{"k": '), (k % 100).cast("string"), F.lit(', "name": "'),
        F.repeat(F.lit("ab"), (k % 40).cast("int")), F.lit('", "ok": '),
        F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "items": [1, 2'),
        F.repeat(F.lit(", 3"), (k % 3).cast("int")), F.lit('], "none": null, "o": {"a": 1}'),
        F.when(k % 5 == 0, ', "x": 1, "y": 2').otherwise(""), F.lit("}"))
    return e.select(
        _run_id().alias("run_id"), k.alias("seq"),
        F.get(F.array(*[F.lit(x) for x in AGENTS]), (k % 5).cast("int")).alias("agent"),
        F.when(k % 29 == 0, "v2").otherwise("v1").alias("prompt_version"),
        (k % 900 + 100).alias("input_tokens"), (k % 300).alias("output_tokens"),
        (k % 50).alias("cache_read_tokens"), F.floor(F.col("value") * 10).alias("duration_ms"),
        F.when(k % 17 == 0, "timed out").alias("error"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, "{broken").when(k % 23 == 0, "{}")
        .otherwise(shape_).alias("output_json"), tools.alias("tool_calls"))


def routing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'signup', 'view')")
    k = F.col("event_id")
    return e.select(
        _run_id().alias("run_id"), k.alias("seq"),
        F.get(F.array(*[F.lit(n) for n in values.NODE_ORDER]), (k % 5).cast("int")).alias("node"),
        F.get(F.array(*[F.lit(x) for x in AGENTS]), (k % 3).cast("int")).alias("agent"),
        F.when(k % 9 == 0, "refused_budget").when(k % 10 == 0, "skipped").otherwise("granted")
        .alias("disposition"),
        (k % 10 != 0).alias("needed"), F.lit("work to do").alias("reason"))


def rate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for three runs in four; the others have none."""
    runs = table(spark, sf_dir, "events").select("user_id").distinct()
    return runs.filter("user_id % 4 <> 3").select(
        _run_id().alias("run_id"), F.lit("3.0").cast("decimal(10,4)").alias("input_per_mtok"),
        F.lit("15.0").cast("decimal(10,4)").alias("output_per_mtok"),
        F.lit("0.3").cast("decimal(10,4)").alias("cache_read_per_mtok"))


def run_documents(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """A nested document per event; the second version moves some fields."""
    k = F.col("event_id")
    extra = F.lit("")
    n, items = F.lit(0), F.lit("")
    if second:
        n = F.when(k % 7 == 0, 1).otherwise(0)
        items = F.when(k % 11 == 0, ", 9").otherwise("")
        extra = F.when(k % 13 == 0, ', "extra": {"why": {"deep": 1}}').otherwise("")
    doc = F.concat(
        F.lit('{"run": "R-'), F.col("user_id").cast("string"), F.lit('", "props": {"k": '),
        (k % 50 + n).cast("string"), F.lit('}, "items": ['), (k % 3).cast("string"), F.lit(", "),
        (k % 5).cast("string"), items, F.lit('], "nodes": [{"node": "a", "duration_ms": '),
        (k * (2 if second else 1)).cast("string"), F.lit("}]"), extra, F.lit("}"))
    return table(spark, sf_dir, "events").select(k.alias("doc_id"), doc.alias("doc"))


def odd_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a document per event: by its last digit broken, of one side only, twenty levels deep, a
    hundred fields wide, with another kind of value or a field more, or 1 written as 1.0."""
    k = F.col("event_id")
    case = k % 10

    def version(second: bool) -> Column:
        deep = F.concat(F.repeat(F.lit('{"d": '), F.lit(20)), F.lit("2" if second else "1"), F.repeat(F.lit("}"), F.lit(20)))
        changed = F.when(case == 5, "-1").when(case == 6, "[3]").otherwise('"s"') if second else F.lit('"s"')
        wide = F.concat(F.lit('{"w": {'), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(
            F.lit('"f'), i.cast("string"), F.lit('": '), F.when(i == k % 100, changed).otherwise(i.cast("string")))), ", "), F.lit("}}"))
        return (F.when((case == 1), "{broken" if second else "{}").when(case == 4, deep).when(case.isin(5, 6), wide)
                .when(case == 7, '{"x": {"y": [1, {}]}, "z": null}' if second else '{"z": null}')
                .otherwise('{"one": 1.0, "list": [true, "a"]}' if second else '{"list": [true, "a"], "one": 1}'))

    events = table(spark, sf_dir, "events")
    return (events.filter(case != 2).select(k.alias("doc_id"), version(False).alias("doc")),
            events.filter(case != 3).select(k.alias("doc_id"), version(True).alias("doc")))


def baseline_claims(metrics: DataFrame) -> DataFrame:
    """A correct claim table with its labels, the start of every planted fixture."""
    names = F.create_map(*[F.lit(x) for n in NATIONALITIES for x in (n, LABEL_NAMES[n][1])])
    return metrics.filter("computed is not null").select(
        "submission_id", "metric", "period", "dimension", "value_key", "metric_key",
        F.col("computed").alias("value"), names[F.col("value_key")].alias("label"), "permuted")


def expected_findings(findings: DataFrame) -> DataFrame:
    """What a fixture expected of each finding, wrong in places by finding number."""
    n = F.substring("finding_id", 3, 4).cast("int")
    out = findings.filter(n % 10 != 0).withColumns({
        "fixture_id": F.col("submission_id"),
        "list": F.when(F.col("variance_class") == "V2", "definitional_items").otherwise("findings"),
        "metric_key": F.when(n % 17 == 0, F.concat("metric_key", F.lit("?")))
        .otherwise(F.col("metric_key")),
        "variance_class": F.when(n % 11 == 0, "V7").otherwise(F.col("variance_class")),
        "claimed": F.when(n % 13 == 0, F.col("claimed") + 1).otherwise(F.col("claimed")),
    })
    return out


def rule_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One included/excluded rule per guest group, as its own stays suggest it. Sets over a closed
    vocabulary, so they stay small however many stays a group has."""
    res = reservations(spark, sf_dir)
    odd = F.col("order_no") % 2 == 1
    return res.groupBy("submission_id", "nationality_iso2").agg(
        F.collect_set(F.when(odd, F.col("status"))).alias("included"),
        F.collect_set(F.when(~odd, F.col("status"))).alias("excluded"))


OTHER_TOLERANCE = "0.50"


def other_policy() -> Policy:
    """Complimentary stays don't count, house use is no alternative any more, the band is 0.50 and roundings are
    material."""
    document = committed_document()
    document["version"] = "9.0.0"
    rates = document["qualifying"]["rate_code"]
    rates["included"], rates["excluded"] = ["BAR", "CORP", "GOV", "OTA", "GROUP"], ["COMP", "HOUSE"]
    ordered = document["permutations"]["ordered"]
    ordered[:] = [p for p in ordered if p["id"] not in ("P-COMP-EXCLUDED", "P-HOUSE-INCLUDED")][::-1]
    document["tolerances"]["by_metric_type"]["percentage_points"]["value"] = float(OTHER_TOLERANCE)
    document["materiality"]["severity_by_class"]["V6"] = "material"
    return parse_policy(document)
