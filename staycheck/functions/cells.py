"""A1 references and cell text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.text import let

A1_RANGE = "^[A-Z]{1,3}[1-9][0-9]{0,6}(:[A-Z]{1,3}[1-9][0-9]{0,6})?$"


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    def letter(c: Column) -> Column:
        return F.char((c + 65).cast("bigint"))
    two = n - 27
    three = n - 703
    div = lambda c, k: F.floor(c / k)
    return (
        F.when(n <= 26, letter(n - 1))
        .when(n <= 702, F.concat(letter(div(two, 26)), letter(two % 26)))
        .otherwise(F.concat(letter(div(three, 676)), letter(div(three, 26) % 26), letter(three % 26)))
    )


def column_number(letters: Column) -> Column:
    chars = F.split(letters, "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0),
                       lambda acc, c: acc * 26 + F.ascii(c) - 64)


def cell_ref(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def parse_rect(text: Column) -> Column:
    """An A1 cell or range to its inclusive bounds, or null where it is not one or is inverted."""
    def bounds(ref: Column) -> Column:
        first, last = F.substring_index(ref, ":", 1), F.substring_index(ref, ":", -1)
        return F.when(ref.rlike(A1_RANGE), F.struct(
            column_number(F.regexp_extract(first, "^[A-Z]+", 0)).alias("min_col"),
            F.regexp_extract(first, "[0-9]+$", 0).try_cast("int").alias("min_row"),
            column_number(F.regexp_extract(last, "^[A-Z]+", 0)).alias("max_col"),
            F.regexp_extract(last, "[0-9]+$", 0).try_cast("int").alias("max_row")))

    return let(let(F.upper(F.trim(text)), bounds), lambda r: F.when(
        (r["min_col"] <= r["max_col"]) & (r["min_row"] <= r["max_row"]), r))


def render_rect(rect: Column) -> Column:
    start = cell_ref(rect["min_row"], rect["min_col"])
    end = cell_ref(rect["max_row"], rect["max_col"])
    return F.when(start == end, start).otherwise(F.concat(start, F.lit(":"), end))


def _undecorated(text: Column, units: list[str], parenthesised: Column) -> Column:
    """Text of a figure without its parentheses, percent sign, currency symbols and unit words."""
    out = F.when(parenthesised, F.trim(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    out = F.trim(F.regexp_replace(out, "%$", ""))
    out = F.trim(F.regexp_replace(out, f"[{values.CURRENCY_SYMBOLS}]", ""))
    for unit in units:
        out = F.trim(F.regexp_replace(out, f"(?i)^{unit}", ""))
        out = F.trim(F.regexp_replace(out, f"(?i){unit}$", ""))
    return out


def _no_thousands(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}\b)", "")


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def cell_value(text: Column, number: Column, number_format: Column, value_type: Column) -> Column:
    """A cell to {value, problem}; both null for an empty cell.

    A number under a percent format is a stored fraction and is scaled to points; percent text is
    in points already. A figure with more than ten decimals is a problem, never silently rounded.
    """
    def read(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")")
        plain = _no_thousands(_undecorated(t, values.VALUE_UNITS, negative))
        parsed = let(plain, lambda p: F.when(p.rlike(NUMBER), F.struct(
            p.try_cast("decimal(38,18)").alias("n"),
            p.rlike(r"\.[0-9]{10,}[1-9]").alias("long"))))
        one = F.lit(1).cast("decimal(1,0)")

        def result(p: Column) -> Column:
            fraction = p["n"] % one
            return F.struct(
                F.when(negative, -p["n"]).otherwise(p["n"]).cast("decimal(38,10)").alias("value"),
                F.when(t.startswith("="), "uncached formula").when(p["n"].isNull(), "not a figure")
                .when(p["long"] | (fraction != fraction.cast("decimal(19,10)")),
                      "too many decimals").alias("problem"))

        return let(parsed, result)

    scaled = F.when(number_format.contains("%"), number * 100).otherwise(number)
    kind_problem = F.when(value_type.isin("boolean", "date"),
                          F.concat(value_type, F.lit(" is not a figure")))
    nothing = F.lit(None).cast("decimal(38,10)")
    cell = (
        F.when(kind_problem.isNotNull(), F.struct(
            nothing.alias("value"), kind_problem.alias("problem")))
        .when(number.isNotNull(), F.struct(
            scaled.cast("decimal(38,10)").alias("value"),
            F.lit(None).cast("string").alias("problem")))
        .when(F.coalesce(F.trim(text), F.lit("")) != "", let(F.trim(text), read)))
    return let(cell, lambda c: F.struct(
        F.when(c["problem"].isNull(), c["value"]).alias("value"), c["problem"].alias("problem")))


def looks_numeric(text: Column) -> Column:
    """Whether text reads as a quantity rather than as a label."""
    t = F.trim(text)
    plain = _undecorated(t, values.LABEL_UNITS, t.startswith("(") & t.endswith(")"))
    return F.coalesce(let(plain, lambda p: p.rlike("^[0-9]+$") | _no_thousands(p).rlike(NUMBER)),
                      F.lit(False))


def masked(text: Column, number: Column, value_type: Column) -> Column:
    """A cell as a reader without access to figures may see it."""
    t = F.trim(text)
    return (
        F.when(number.isNotNull() | value_type.isin("boolean", "date"), "<value>")
        .when(t.isNull() | (t == ""), None)
        .when(t.startswith("="), "<formula>")
        .when(looks_numeric(t), "<value>")
        .otherwise(t)
    )
