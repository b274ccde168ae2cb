"""Row contracts: every broken rule is named, nothing is repaired."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.periods import period_days
from staycheck.functions.text import opaque_ref, parse_iso_date, parse_whole_number
from staycheck.operators.reconcile import violations


def reservation_rules() -> dict:
    col = F.col
    nights = F.datediff("departure_date", "arrival_date")
    rules = {
        "guest_ref": ~opaque_ref(col("guest_ref")),
        "nationality": ~col("nationality_iso2").rlike("^[A-Z]{2}$"),
        "adults": col("adults") < 1,
        "children": col("children") < 0,
        "rooms": col("rooms") < 1,
        "departure_before_arrival": nights < 0,
        "nights": col("nights") != nights,
        "room_nights": col("room_nights") != col("nights") * col("rooms"),
        "status": ~col("status").isin(*values.STATUSES),
        "rate_code": ~col("rate_code").isin(*values.RATE_CODES),
    }
    return {name: F.coalesce(cond, F.lit(True)) for name, cond in rules.items()}


def check_reservations(res: DataFrame) -> DataFrame:
    return violations(res, reservation_rules())


def check_inventory(inv: DataFrame) -> DataFrame:
    """The printed availability is compared with total minus out of order, never adopted."""
    col = F.col
    printed = col("rooms_available") if "rooms_available" in inv.columns else F.lit(None).cast("int")
    unreadable = F.size("unreadable") > 0 if "unreadable" in inv.columns else F.lit(False)
    return violations(inv, {
        "unreadable": unreadable,
        "day": col("day").isNull(),
        "rooms_total": F.coalesce(col("rooms_total") < 0, F.lit(True)),
        "rooms_out_of_order": F.coalesce(col("rooms_out_of_order") < 0, F.lit(True)),
        "out_of_order_above_total": col("rooms_out_of_order") > col("rooms_total"),
        "printed_availability": printed.isNotNull() & (
            printed != col("rooms_total") - col("rooms_out_of_order")),
    })


def inventory_gaps(inv: DataFrame, declared: DataFrame) -> DataFrame:
    """Days of the declared periods with no row, for submissions that filed an inventory.

    Spark takes days expanded from ranges for as few as the ranges, and would broadcast them all, so this join
    is asked to sort and merge."""
    filed = inv.select("submission_id").distinct()
    days = period_days(declared.join(filed, "submission_id", "left_semi"))
    return days.select("submission_id", "day").distinct().join(
        inv.select("submission_id", "day").hint("merge"), ["submission_id", "day"], "left_anti")


def repeated_days(inv: DataFrame) -> DataFrame:
    return inv.groupBy("submission_id", "day").agg(F.count("*").alias("rows")).filter("rows > 1")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Spark applies the limit before the shuffle as well, so a very
    frequent key sends at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)


def duplicate_ids(rows: DataFrame, keys: list[str], ref: list[str], shown: int = 3) -> DataFrame:
    """Ids that repeat inside `keys`: how often, the first few references and how many are left
    out."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
    refs = first_rows(rows.select(*keys, *ref), keys, ref, shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*ref))).alias("refs"))
    return counts.join(refs, keys).withColumn("more", F.greatest(F.col("rows") - shown, F.lit(0)))


def bounded_listing(df: DataFrame, keys: list[str], item: str, shown: int) -> DataFrame:
    """The first `shown` items of each key and a count of the rest."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    listed = first_rows(df.select(*keys, item), keys, [item], shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("shown"))
    return counts.join(listed, keys).withColumn(
        "more", F.greatest(F.col("_all") - shown, F.lit(0))).drop("_all")


def edge_quotas(res: DataFrame, first_day, last_day, quotas: dict | None = None) -> DataFrame:
    """How many of each edge case a submission holds, and whether that meets the quota."""
    quotas = quotas or values.EDGE_QUOTAS
    col = F.col
    spans = F.trunc("arrival_date", "month") < F.trunc(
        F.date_sub("departure_date", F.when(col("nights") > 0, 1).otherwise(0)), "month")
    measures = {
        "month_spanning": F.count_if(spans),
        "comp": F.count_if(col("rate_code") == "COMP"),
        "house": F.count_if(col("rate_code") == "HOUSE"),
        "day_use": F.count_if(col("nights") == 0),
        "arriving_before_period": F.count_if(col("arrival_date") < first_day),
        "in_house_at_period_end": F.count_if(
            (col("status") == "IN_HOUSE") & (col("departure_date") > last_day)),
        "multi_room": F.count_if(col("rooms") > 1),
        "nationalities": F.count_distinct("nationality_iso2"),
    }
    wide = res.groupBy("submission_id").agg(*[m.alias(k) for k, m in measures.items()])
    pairs = ", ".join(f"'{k}', {k}, {int(q)}" for k, q in quotas.items())
    return wide.selectExpr(
        "submission_id", f"stack({len(quotas)}, {pairs}) as (edge, have, need)"
    ).withColumn("met", col("have") >= col("need"))


def parse_printed(cells: DataFrame) -> DataFrame:
    """Printed text of one report row to typed fields and the names of what could not be read.

    A day-use marker stands for the arrival date. Printed nights and room-night totals are compared
    with the dates, never adopted.
    """
    col = F.col
    arrival = parse_iso_date(col("arrival"))
    day_use = F.lower("departure").contains(values.DAY_USE_MARKER)
    departure = F.when(day_use, arrival).otherwise(parse_iso_date(col("departure")))
    whole = {c: parse_whole_number(col(c)) for c in (
        "nights", "rooms", "adults", "children", "room_nights_total", "room_nights_month")}
    typed = cells.withColumns({
        "arrival_date": arrival, "departure_date": departure,
        **{f"{c}_n": parsed for c, parsed in whole.items()},
    })
    nights = F.datediff("departure_date", "arrival_date")
    rules = {
        "arrival": col("arrival_date").isNull(),
        "departure": col("departure_date").isNull(),
        **{c: col(f"{c}_n").isNull() for c in whole},
        "printed_nights": col("nights_n") != nights,
        "printed_room_nights": col("room_nights_total_n") != nights * col("rooms_n"),
        "word_outside_bands": col("stray_words") > 0,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]),
                     lambda x: x.isNotNull())
    return typed.withColumn("defects", found)
