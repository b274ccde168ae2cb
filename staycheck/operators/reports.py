"""Monthly reports: words to rows, printed totals, and whether the two agree."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.text import let
from staycheck.operators.metrics import stay_months
from staycheck.operators.reconcile import violations
from staycheck.sources.rulesets import rulesets

LINE = ["submission_id", "file", "page", "line_top"]
FIELDS = [b[0] for b in values.BANDS]


def band_of(midpoint: Column) -> Column:
    """The column a word's midpoint falls in, or null for none."""
    chain = None
    for field, left, right, _ in values.BANDS:
        cond = (midpoint >= left) & (midpoint < right)
        chain = F.when(cond, field) if chain is None else chain.when(cond, field)
    return chain


def assign_bands(words: DataFrame) -> DataFrame:
    return words.withColumns({
        "band": band_of((F.col("x0") + F.col("x1")) / 2), "line_top": F.round("top", 1)})


def data_lines(words: DataFrame, id_pattern: str = values.RESERVATION_ID_PATTERN) -> DataFrame:
    """One row per printed reservation: its number on the page, its cells and its height.

    Words are gathered per visual line, which the page width bounds.
    """
    lines = assign_bands(words).groupBy(*LINE).agg(
        F.min_by("text", "x0").alias("first_text"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.count_if(F.col("band").isNull()).alias("stray_words"),
        F.array_sort(F.collect_list(F.struct("x0", "text", "band"))).alias("words"),
    ).filter(F.col("first_text").rlike(id_pattern))
    page = Window.partitionBy("submission_id", "file", "page").orderBy("line_top")

    def cell(field: str) -> Column:
        mine = F.filter("words", lambda w: w["band"] == field)
        return F.array_join(F.transform(mine, lambda w: w["text"]), " ").alias(field)

    return lines.withColumn("row_no", F.row_number().over(page)).select(
        "submission_id", "file", "page", "row_no", "top", "bottom", "stray_words",
        *[cell(f) for f in FIELDS])


EXPECTED_HEADER = " ".join(b[3] for b in values.BANDS)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def has_header(text: Column) -> Column:
    return F.exists(F.split(text, "\n"), lambda line: squeezed(line) == EXPECTED_HEADER)


def property_code(text: Column) -> Column:
    code = F.regexp_extract(text, r"Property\s+([A-Z0-9][A-Z0-9-]{2,31})", 1)
    return F.when(code != "", code)


def check_layout(pages: DataFrame) -> DataFrame:
    return violations(pages, {
        "header": ~has_header(F.col("text")), "property": property_code(F.col("text")).isNull()})


def page_columns(words: DataFrame) -> DataFrame:
    """The text left and right of the split, line by line; bounded by what one page holds."""
    lines = words.withColumns({
        "line_top": F.round("top", 1), "is_left": F.col("x0") < values.COLUMN_SPLIT_X,
    }).groupBy(*LINE, "is_left").agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("words"))
    lines = lines.withColumn("line", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    def column(flag: Column) -> Column:
        mine = F.array_sort(F.collect_list(F.when(flag, F.struct("line_top", "line"))))
        return F.array_join(F.transform(mine, lambda x: x["line"]), "\n")

    return lines.groupBy("submission_id", "file", "page").agg(
        column(F.col("is_left")).alias("left_text"), column(~F.col("is_left")).alias("right_text"))


def parse_totals(blocks: DataFrame) -> DataFrame:
    """What a report prints about itself; a figure it does not print is named in `missing`."""

    def first(col: str, pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract(col, pattern, group)
        return F.when(found != "", found)

    listed = r"Sum of the RN Month column over all\s+([0-9]+)\s+listed rows:\s+([0-9]+)"
    body = F.regexp_extract(
        "left_text", r"(?s)Rows listed but excluded from the total:\s*(.+?)(?:Complimentary|$)", 1)
    item = r"([0-9]+)\s+([a-z][a-z \-()]*?)\s*(?=,|$)"
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    nat = r"(?m)^([A-Z]{2})\s+([0-9]+)$"

    def mapping(text, pattern, key, value):
        """The figure by name; of a name printed twice the last one counts."""
        keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(key)), F.trim)
        found = F.arrays_zip(keys.alias("k"), F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(value)),
            lambda x: x.try_cast("bigint")).alias("v"))
        return F.map_from_entries(let(found, lambda es: F.filter(es, lambda e, i: ~F.exists(
            F.slice(es, i + 2, F.size(es)), lambda later: later["k"] == e["k"]))))

    out = blocks.withColumns({
        "sold": first("left_text", r"Room nights sold\s+([0-9]+)").try_cast("bigint"),
        "available": first("left_text", r"Room nights available\s+([0-9]+)").try_cast("bigint"),
        "occupancy": first("left_text", r"Occupancy\s+([0-9]+\.[0-9]{2})%").try_cast("decimal(20,2)"),
        "listed_rows": first("left_text", listed, 1).try_cast("bigint"),
        "listed_room_nights": first("left_text", listed, 2).try_cast("bigint"),
        "excluded": mapping(flat, item, 2, 1),
        "guests": mapping(F.col("right_text"), nat, 1, 2),
        "total_guests": first("right_text", r"Total guests\s+([0-9]+)").try_cast("bigint"),
    })
    required = ["sold", "available", "occupancy", "listed_rows", "total_guests"]
    return out.withColumn("missing", F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), c) for c in required])))


def exclusion() -> Column:
    """Why a listed row is not in the total, in the order the report decides it."""
    base = rulesets()[0]
    return (
        F.when(F.col("status") == "CANCELLED", "cancelled")
        .when(F.col("status") == "NO_SHOW", "no_show")
        .when(F.col("rate_code") == "HOUSE", "house_use")
        .when((F.col("nights") == 0) & F.col("status").isin(*base.status_in)
              & F.col("rate_code").isin(*base.rate_in), "day_use")
    )


def _qualifies() -> Column:
    base = rulesets()[0]
    return F.col("status").isin(*base.status_in) & F.col("rate_code").isin(*base.rate_in)


def extracted_totals(listed: DataFrame) -> DataFrame:
    """The same figures from the rows read, as (submission, month, check_name, code, value)."""
    keys = ["submission_id", "month"]
    arrives = F.date_format("arrival_date", "yyyy-MM") == F.col("month")
    party = F.when(_qualifies() & arrives, F.col("adults") + F.col("children")).otherwise(0)
    by_nat = listed.withColumn("x", exclusion()).groupBy(*keys, "nationality_iso2").agg(
        F.count("*").alias("listed_rows"),
        F.sum("room_nights_month").alias("listed_room_nights"),
        F.sum(F.when(_qualifies(), F.col("rooms") * F.col("nights_in")).otherwise(0)).alias("sold"),
        *[F.count_if(F.col("x") == name).alias(name) for _, name in values.EXCLUSION_LABELS],
        F.sum(party).alias("guests"), F.count_if(_qualifies() & arrives).alias("arrivals"))
    names = ["listed_rows", "listed_room_nights", "sold",
             *[name for _, name in values.EXCLUSION_LABELS]]
    # the nationalities of one report are few, so the totals and the per-code rows share one pass
    per = by_nat.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in names], F.sum("guests").alias("total_guests"),
        F.collect_list(F.when(F.col("arrivals") > 0, F.struct(
            F.lit("guests").alias("check_name"), F.col("nationality_iso2").alias("code"),
            F.col("guests").alias("value")))).alias("by_code"))
    fixed = F.array(*[F.struct(F.lit(c).alias("check_name"), F.lit("").alias("code"),
                               F.col(c).alias("value")) for c in [*names, "total_guests"]])
    return per.select(*keys, F.explode(F.concat(fixed, "by_code")).alias("e")).select(*keys, "e.*")


def printed_checks(parsed: DataFrame) -> DataFrame:
    """Printed totals in the same long form."""
    def item(name, value, code=""):
        return F.struct(F.lit(name).alias("check_name"), F.lit(code).alias("code"),
                        value.cast("bigint").alias("value"))
    fixed = [item(c, F.col(c)) for c in
             ("listed_rows", "listed_room_nights", "sold", "total_guests")]
    fixed += [item(name, F.col("excluded")[label]) for label, name in values.EXCLUSION_LABELS]
    codes = F.transform(F.map_entries("guests"), lambda e: F.struct(
        F.lit("guests").alias("check_name"), e["key"].alias("code"),
        e["value"].cast("bigint").alias("value")))
    return parsed.select("submission_id", "month", F.explode(
        F.concat(F.array(*fixed), codes)).alias("e")).select("submission_id", "month", "e.*")


def reconcile_totals(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every figure a report prints that its own rows do not give, per nationality code too.

    An exclusion label the report does not print is a disagreement, not a passed check.
    """
    keys = ["submission_id", "month", "check_name", "code"]
    ours = extracted_totals(listed).withColumnRenamed("value", "extracted")
    theirs = printed_checks(parsed).withColumnRenamed("value", "printed").withColumn(
        "stated", F.lit(True))
    both = ours.join(theirs, keys, "full_outer").join(
        parsed.select("submission_id", "month").distinct(), ["submission_id", "month"], "left_semi")
    absent = F.coalesce("stated", F.lit(False)) & F.col("printed").isNull()
    differs = F.coalesce("printed", F.lit(0)) != F.coalesce("extracted", F.lit(0))
    return both.filter(absent | differs).select(*keys, "printed", "extracted")


def page_subtotals(listed: DataFrame) -> DataFrame:
    q = _qualifies()
    return listed.groupBy("submission_id", "file", "page").agg(
        F.count("*").alias("listed"),
        F.sum(F.when(q, F.col("room_nights")).otherwise(0)).alias("room_nights"),
        F.sum(F.when(q, F.col("room_nights_month")).otherwise(0)).alias("room_nights_month"))


COMPARED = ["hotel_id", "guest_ref", "nationality_iso2", "adults", "children", "rooms", "nights",
            "arrival_date", "departure_date", "status", "rate_code"]


def merge_reports(rows: DataFrame) -> DataFrame:
    """One row per reservation with its earliest citation; `conflicts` names the fields two
    printings disagree on, a value against none included. split_merged drops such reservations."""
    compared = [c for c in COMPARED if c in rows.columns]
    first = F.min(F.struct("file", "page", "row_no", *compared))
    differ = [F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), c) for c in compared]
    out = rows.groupBy("submission_id", "reservation_id").agg(
        first.alias("r"), F.count("*").alias("printings"),
        F.array_compact(F.array(*differ)).alias("conflicts"))
    return out.select("submission_id", "reservation_id", "r.*", "printings", "conflicts")


def split_merged(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reservations all printings agree on, and those they don't."""
    agreed = F.size("conflicts") == 0
    return merged.filter(agreed).drop("conflicts"), merged.filter(~agreed)


def extraction_summary(rows: DataFrame, disagreements: DataFrame) -> DataFrame:
    """Distinct reservations, pages, duplicates inside one report, and whether totals matched."""
    per_id = rows.groupBy("submission_id", "reservation_id", "file").agg(F.count("*").alias("n"))
    ids = per_id.groupBy("submission_id", "reservation_id").agg(F.max("n").alias("n")).groupBy(
        "submission_id").agg(F.count("*").alias("records"), F.count_if(F.col("n") > 1)
                             .alias("duplicates"))
    pages = rows.select("submission_id", "file", "page").distinct().groupBy("submission_id").agg(
        F.count("*").alias("pages"), F.count_distinct("file").alias("files"))
    off = disagreements.groupBy("submission_id").agg(F.count("*").alias("_off"))
    return ids.join(pages, "submission_id").join(off, "submission_id", "left").withColumn(
        "matched", F.col("_off").isNull()).drop("_off")


def listed_rows(res: DataFrame) -> DataFrame:
    """Reservations as a monthly report lists them: once in every month with a night or an arrival,
    with that month's room-nights."""
    return stay_months(res).filter("arrives or nights_in > 0").withColumns({
        "month": F.date_format("month", "yyyy-MM"),
        "room_nights_month": F.col("rooms") * F.col("nights_in"),
    }).withColumn("file", F.concat(F.lit("pms_"), "month", F.lit(".pdf")))
