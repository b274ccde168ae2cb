"""Period labels (YYYY-MM, YYYY-Qn, YYYY) and the dates they cover."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.text import let

MONTH_LABEL = "^[0-9]{4}-(0[1-9]|1[0-2])$"
QUARTER_LABEL = "^[0-9]{4}-Q[1-4]$"
YEAR_LABEL = "^[0-9]{4}$"


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))


def year_label(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def period_kind(label: Column) -> Column:
    return (
        F.when(label.rlike(MONTH_LABEL), "month")
        .when(label.rlike(QUARTER_LABEL), "quarter")
        .when(label.rlike(YEAR_LABEL), "year")
    )


def is_valid_period(label: Column) -> Column:
    return F.coalesce(period_kind(label).isNotNull(), F.lit(False))


def first_day(label: Column) -> Column:
    year = F.substring(label, 1, 4).cast("int")
    month = (
        F.when(label.rlike(MONTH_LABEL), F.substring(label, 6, 2).cast("int"))
        .when(label.rlike(QUARTER_LABEL), F.substring(label, 7, 1).cast("int") * 3 - 2)
        .when(label.rlike(YEAR_LABEL), F.lit(1))
    )
    return F.when(period_kind(label).isNotNull(), F.make_date(year, month, F.lit(1)))


def last_day(label: Column) -> Column:
    months = (
        F.when(label.rlike(MONTH_LABEL), 0)
        .when(label.rlike(QUARTER_LABEL), 2)
        .when(label.rlike(YEAR_LABEL), 11)
    )
    return F.last_day(F.add_months(first_day(label), months))


def period_bounds(df: DataFrame, label: str = "period") -> DataFrame:
    col = F.col(label)
    return df.withColumns({
        "kind": period_kind(col), "first_day": first_day(col), "last_day": last_day(col),
    })


def period_months(df: DataFrame, label: str = "period", out: str = "month") -> DataFrame:
    """One row per month of the period; a month yields itself."""
    col = F.col(label)
    return df.filter(is_valid_period(col)).withColumn(
        out,
        F.explode(F.transform(
            F.expr(f"sequence({first_day_sql(label)}, {last_day_sql(label)}, interval 1 month)"),
            month_label,
        )),
    )


def period_days(df: DataFrame, label: str = "period", out: str = "day") -> DataFrame:
    return df.withColumns({"_a": first_day(F.col(label)), "_b": last_day(F.col(label))}).filter(
        "_a is not null"
    ).withColumn(out, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def first_day_sql(label: str) -> str:
    return (
        f"make_date(cast(substring({label},1,4) as int), case when {label} rlike '{MONTH_LABEL}' "
        f"then cast(substring({label},6,2) as int) when {label} rlike '{QUARTER_LABEL}' "
        f"then cast(substring({label},7,1) as int)*3-2 else 1 end, 1)"
    )


def last_day_sql(label: str) -> str:
    return (
        f"last_day(add_months({first_day_sql(label)}, case when {label} rlike '{MONTH_LABEL}' "
        f"then 0 when {label} rlike '{QUARTER_LABEL}' then 2 else 11 end))"
    )


def periods_of_month(month: Column) -> Column:
    """The three labels a month (given as its first day) rolls into."""
    return F.array(month_label(month), quarter_label(month), year_label(month))


_EDGE = " \t,;:\\-–—"


def _month_number(name: Column) -> Column:
    out = None
    for number, names in enumerate(values.MONTH_NAMES, start=1):
        cond = F.lower(name).isin(*names)
        out = F.when(cond, F.lit(f"{number:02d}")) if out is None else out.when(
            cond, F.lit(f"{number:02d}"))
    return out


def parse_period_label(text: Column) -> Column:
    """A human label to the canonical one, or null: 'January 2026' -> '2026-01'."""
    noise = r"(?i)\b(" + "|".join(values.PERIOD_NOISE_WORDS) + r")\b"
    cleaned = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(text, noise, ""), f"^[{_EDGE}]+", ""), f"[{_EDGE}]+$", "")
    quarter = r"(?i)^([0-9]{4})[-\s]?Q([1-4])$"
    name_year = r"^([A-Za-z]+)[\s,\-]+([0-9]{4})$"
    year_name = r"^([0-9]{4})[\s,\-]+([A-Za-z]+)$"

    def rendered(c: Column) -> Column:
        def part(pattern, group):
            return F.regexp_extract(c, pattern, group)

        def named(pattern, name, year):
            return let(part(pattern, name), lambda n: F.concat(
                part(pattern, year), F.lit("-"), _month_number(n)))

        return (
            F.when(c.rlike("^[0-9]{4}-[0-9]{2}$") | c.rlike(YEAR_LABEL), c)
            .when(c.rlike(quarter), F.concat(part(quarter, 1), F.lit("-Q"), part(quarter, 2)))
            .when(c.rlike(name_year), named(name_year, 1, 2))
            .when(c.rlike(year_name), named(year_name, 2, 1))
        )

    return let(let(cleaned, rendered), lambda r: F.when(is_valid_period(r), r))
