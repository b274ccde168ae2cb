"""Recompute every metric under every ruleset in one pass over the reservations.

Reservations are expanded only to the calendar months they touch. An aggregate to (submission, month)
and one to (submission, month, nationality) carry a sum per distinct reading of the rules; months then
roll up into quarters and years on those smaller tables. So the reservations are read twice for all
rulesets together, once for the figures of periods and once for those of nationalities, and each side
carries only the sums it needs.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions import periods
from staycheck.functions.keys import render_key
from staycheck.session import spread
from staycheck.sources.rulesets import Ruleset, rulesets

VALUE_TYPE = "decimal(38,10)"
# inside the plan values are whole counts or two-place percentages, which fit a machine word
SLIM_TYPE = "decimal(18,2)"


def with_stay_columns(res: DataFrame) -> DataFrame:
    nights = F.datediff("departure_date", "arrival_date")
    return res.withColumns({
        "nights": nights,
        "room_nights": nights * F.col("rooms"),
        "is_day_use": nights == 0,
        "guests": F.col("adults") + F.col("children"),
    })


def occupied_nights(res: DataFrame) -> DataFrame:
    """One row per occupied night; the departure night is not occupied and a day use has none."""
    last = F.date_sub("departure_date", 1)
    return res.filter(F.col("departure_date") > F.col("arrival_date")).withColumn(
        "night", F.explode(F.sequence(F.col("arrival_date"), last)))


def qualifying(res: DataFrame, rules: Ruleset) -> DataFrame:
    return res.filter(_qualifies(rules))


def _qualifies(rules: Ruleset) -> Column:
    return F.col("status").isin(*rules.status_in) & F.col("rate_code").isin(*rules.rate_in)


def stay_months(res: DataFrame) -> DataFrame:
    """One row per reservation and calendar month touched, with what it contributes there."""
    first = F.trunc("arrival_date", "month")
    last = F.trunc("departure_date", "month")
    month = F.col("month")
    nights_in = F.greatest(F.lit(0), F.datediff(
        F.least(F.col("departure_date"), F.add_months(month, 1)),
        F.greatest(F.col("arrival_date"), month)))
    return (
        res.withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
        .withColumns({
            "nights_in": nights_in,
            "arrives": month == first,
            "departs": month == last,
            "is_day_use": F.col("arrival_date") == F.col("departure_date"),
        })
        .withColumn("stays", (F.col("nights_in") > 0) | (F.col("is_day_use") & F.col("arrives")))
        .withColumns({
            # the occupied months of a stay are consecutive, so the first one inside a quarter is
            # the arrival month or the quarter's own first month
            "first_in_quarter": F.col("arrives") | (month == F.trunc("month", "quarter")),
            "first_in_year": F.col("arrives") | (month == F.trunc("month", "year")),
        })
    )


def _in(column: str, members: tuple) -> str:
    return f"{column} in (" + ", ".join(f"'{v}'" for v in members) + ")"


def _who(rules: Ruleset) -> str:
    return f"({_in('status', rules.status_in)} and {_in('rate_code', rules.rate_in)})"


def _sold(rules: Ruleset) -> str:
    basis = {
        "occupied_night": "rooms * nights_in",
        "arrival_month": "if(arrives, room_nights, 0)",
        "departure_month": "if(departs, room_nights, 0)",
    }[rules.occ_month_basis]
    if rules.day_use_counts_room_nights:
        basis = f"if(is_day_use, if(arrives, rooms, 0), {basis})"
    return f"sum(cast(if({_who(rules)}, {basis}, 0) as bigint))"


def _guest_rows(rules: Ruleset) -> str:
    counted = {"occupied_night": "stays", "arrival_month": "arrives",
               "departure_month": "departs"}[rules.nat_month_basis]
    day_use = "" if rules.day_use_counts_guests else " and not is_day_use"
    return f"({_who(rules)} and {counted}{day_use})"


def _contribution(rules: Ruleset) -> str:
    return {
        "guests": "adults + children" if rules.include_children else "adults",
        "arrivals": "1",
        "room_nights": "room_nights",
    }[rules.counts]


@dataclass(frozen=True)
class _Names:
    """Column names of the distinct measures, so equal readings are summed once."""

    touch: str
    sold: str
    guest_rows: str
    guests: str


def _names(rules: Ruleset) -> _Names:
    who = "_".join(s[:3] for s in rules.status_in) + "_" + "_".join(r[:2] for r in rules.rate_in)
    sold = f"{who}_{rules.occ_month_basis}_{int(rules.day_use_counts_room_nights)}"
    rows = f"{who}_{rules.nat_month_basis}_{int(rules.day_use_counts_guests)}"
    guests = f"{rows}_{rules.counts}_{int(rules.include_children)}"
    return _Names(f"t_{who}", f"s_{sold}", f"n_{rows}", f"g_{guests}")


def month_cube(res: DataFrame, rules: list[Ruleset], *by: str) -> DataFrame:
    """Sums per (submission, month) and the columns `by`, one column per distinct measure."""
    measures: dict[str, str] = {}
    for r in rules:
        n = _names(r)
        measures[n.touch] = f"count_if({_who(r)})"
        measures[n.sold] = _sold(r)
        rows, value = _guest_rows(r), _contribution(r)
        measures[n.guest_rows] = f"count_if({rows})"
        measures[n.guests] = f"sum(cast(if({rows}, {value}, 0) as bigint))"
        if r.nat_month_basis == "occupied_night":
            # a stay counts once in a quarter or year however many of its months it touches
            for suffix, flag in (("_q", "first_in_quarter"), ("_y", "first_in_year")):
                measures[n.guests + suffix] = (
                    f"sum(cast(if({rows} and {flag}, {value}, 0) as bigint))")
    return stay_months(res).groupBy("submission_id", "month", *by).agg(
        *[F.expr(f"{sql} as {name}") for name, sql in measures.items()])


def period_rows(cube: DataFrame, rules: list[Ruleset], *by: str) -> DataFrame:
    """Sums per (submission, period) and the columns `by`.

    Rows are dealt by submission and period, which is how they meet the declared periods: summed within that, they
    needn't be sent again."""
    parts: dict[str, str] = {}
    for r in rules:
        n = _names(r)
        for c in (n.touch, n.sold, n.guest_rows, n.guests):
            parts[c] = c
        if r.nat_month_basis == "occupied_night":
            g = n.guests
            parts[g] = f"case kind when 'quarter' then {g}_q when 'year' then {g}_y else {g} end"
    labels = """inline(array(
        struct('month' as kind, date_format(month, 'yyyy-MM') as period),
        struct('quarter' as kind,
               concat(date_format(month, 'yyyy'), '-Q', quarter(month)) as period),
        struct('year' as kind, date_format(month, 'yyyy') as period)))"""
    each = cube.selectExpr("*", labels).selectExpr("submission_id", "period", *by, *[f"{sql} as {name}" for name, sql in parts.items()])
    if by:
        each = each.repartition("submission_id", "period")
    return each.groupBy("submission_id", "period", *by).agg(*[F.sum(name).alias(name) for name in parts])


def inventory_periods(inv: DataFrame) -> DataFrame:
    """Sellable and total room sums and maxima per (submission, period)."""
    net = F.col("rooms_total") - F.col("rooms_out_of_order")
    by_month = inv.groupBy("submission_id", F.trunc("day", "month").alias("month")).agg(
        F.count("*").alias("days"), F.sum(net).alias("net"), F.sum("rooms_total").alias("gross"),
        F.max(net).alias("max_net"), F.max("rooms_total").alias("max_gross"))
    return by_month.withColumn(
        "period", F.explode(periods.periods_of_month(F.col("month")))
    ).groupBy("submission_id", "period").agg(
        *[F.sum(c).alias(c) for c in ("days", "net", "gross")],
        *[F.max(c).alias(c) for c in ("max_net", "max_gross")])


def occupancy_sql(sold: str, denominator: str) -> str:
    """100 * sold / denominator to two places, half up, in whole-number arithmetic. A closed period
    is 0.00, not an error; nothing caps the result at 100."""
    return (f"if({denominator} = 0, cast(0 as decimal(18,2)), cast(cast(({sold} * 20000 + "
            f"{denominator}) div nullif({denominator} * 2, 0) as decimal(18,0)) / 100 "
            "as decimal(18,2)))")


def metric_values(res: DataFrame, inv: DataFrame | None, declared: DataFrame,
                  rules: list[Ruleset] | None = None) -> DataFrame:
    """One row per (submission, metric key).

    computed holds the baseline value, nv_reason why there is none, and permuted the value under
    every alternative that applies to the metric, in committed order (null where that alternative
    has none). Keys only an alternative produces have neither computed nor nv_reason.
    """
    rules = rules or rulesets()
    # periods expanded from submissions or read back packed look few to Spark, which would broadcast them all
    periods_ = declared.select("submission_id", "period").distinct().hint("merge")
    key = ["submission_id", "period"]
    nation = "nationality_iso2"
    base = periods_.join(period_rows(month_cube(res, rules), rules), key, "left")
    if inv is None:
        base = base.selectExpr("*", "0L as days", "0L as net", "0L as gross", "0 as max_net",
                               "0 as max_gross", "false as has_inventory")
    else:
        stocked = inv.select("submission_id").distinct().withColumn("has_inventory", F.lit(True))
        base = base.join(inventory_periods(inv).hint("merge"), key, "left").join(
            stocked, "submission_id", "left").withColumns({
                "has_inventory": F.coalesce("has_inventory", F.lit(False)),
                "days": F.coalesce("days", F.lit(0))})
    guests = periods_.join(period_rows(month_cube(res, rules, nation), rules, nation), key)
    # few rows with much to work out on each: in a union with the many rows of nationalities, adaptive execution
    # would leave them to one task, on which all others wait. Not by the keys as they are, by which the join has
    # dealt them already: with as many partitions Spark would leave this out
    base = spread(base, F.xxhash64(*key))
    # apart, since the code made for both at once is beyond what the JVM compiles
    figures = [base.selectExpr(*key, f"inline(array({_period_entries(rules)}))"),
               guests.selectExpr(*key, *_guests(rules))]
    return figures[0].unionByName(figures[1]).filter(
        "coalesce(computed, any_permuted) is not null or nv_reason is not null"
    ).select(
        "submission_id", "metric", "period", "dimension", "value_key",
        render_key(F.col("metric"), F.col("period"), F.col("dimension"), F.col("value_key"))
        .alias("metric_key"),
        F.col("computed").cast(VALUE_TYPE).alias("computed"), "nv_reason", "permuted")


def _entry(metric: str, dimension: str, value_key: str, computed: str, reason: str,
           permuted: list[tuple[Ruleset, str]], looped: bool = False) -> dict[str, str]:
    """looped: values are typed in a loop over the alternatives. Spark runs that outside its generated code,
    which for many alternatives of a long formula would be one method beyond what the JVM compiles."""
    kind = None if looped else SLIM_TYPE
    found = ", ".join(
        f"named_struct('ord', {r.ord}, 'ruleset_id', '{r.ruleset_id}', "
        f"'value', {f'cast({sql} as {kind})' if kind else sql})" for r, sql in permuted)
    found = f"array({found})"
    if looped and permuted:
        found = f"transform({found}, p -> struct(p.ord, p.ruleset_id, cast(p.value as {SLIM_TYPE}) as value))"
    values_ = ", ".join(f"cast({sql} as {SLIM_TYPE})" for _, sql in permuted)
    array_type = f"array<struct<ord:int,ruleset_id:string,value:{SLIM_TYPE}>>"
    return {
        "metric": f"'{metric}'", "dimension": f"cast({dimension} as string)",
        "value_key": f"cast({value_key} as string)", "computed": f"cast({computed} as {SLIM_TYPE})",
        "nv_reason": f"cast({reason} as string)", "permuted": f"cast({found} as {array_type})",
        "any_permuted": f"coalesce({values_})" if values_ else f"cast(null as {SLIM_TYPE})"}


def _struct(entry: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in entry.items()) + ")"


def _period_entries(rules: list[Ruleset]) -> str:
    """The three figures every declared period has, as SQL structs."""

    def touched(r: Ruleset) -> str:
        return f"coalesce({_names(r).touch}, 0) > 0"

    def value(metric: str, r: Ruleset) -> str:
        rooms = "net" if r.exclude_out_of_order else "gross"
        sold = f"coalesce({_names(r).sold}, 0)"
        if metric == "room_nights_sold":
            return f"if({touched(r)}, {sold}, null)"
        if metric == "room_nights_available":
            return f"if(has_inventory and days > 0, {rooms}, null)"
        if r.denominator == "rooms_available":
            rooms = f"max_{rooms}"
        shown = f"has_inventory and (days > 0 or {touched(r)})"
        return f"case when {shown} then {occupancy_sql(sold, f'coalesce({rooms}, 0)')} end"

    base = rules[0]
    missing = "not has_inventory then 'missing_inventory_reference'"
    reasons = {
        "room_nights_sold": f"if({touched(base)}, null, 'no_source_rows')",
        "room_nights_available": f"case when {missing} when days = 0 then 'no_source_rows' end",
        "occupancy_pct": f"case when {missing} when days = 0 and not ({touched(base)}) "
                         "then 'no_source_rows' end",
    }
    return ", ".join(
        _struct(_entry(m, "null", "null", value(m, base), reason,
                       [(r, value(m, r)) for r in rules[1:] if m in r.applies_to], looped=True))
        for m, reason in reasons.items())


def _guests(rules: list[Ruleset]) -> list[str]:
    """The columns of a nationality's figure, one row as it is. A nationality has a key only where a counted reservation of that nationality exists."""
    metric = "guests_by_nationality"

    def value(r: Ruleset) -> str:
        n = _names(r)
        return f"if({n.guest_rows} > 0, {n.guests}, null)"

    entry = _entry(metric, f"'{values.DIMENSION}'", "nationality_iso2", value(rules[0]), "null",
                   [(r, value(r)) for r in rules[1:] if metric in r.applies_to])
    return [f"{sql} as {name}" for name, sql in entry.items()]


def permuted_values(metrics: DataFrame) -> DataFrame:
    """One row per (submission, metric key, alternative ruleset) that has a value."""
    return metrics.select("submission_id", "metric_key", F.explode("permuted").alias("p")).select(
        "submission_id", "metric_key", "p.ord", "p.ruleset_id", "p.value"
    ).filter("value is not null")
