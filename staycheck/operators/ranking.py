"""Row numbers and running values that hold when one group has a large share of the rows.

A plain window puts a whole group in one task. Here the caller names bucket columns that follow the
order: rows are numbered inside (group, bucket), and a small table of bucket totals supplies the
offset. The result is the same as the plain window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(totals: DataFrame, group: list[str], bucket: list[str], values: dict) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.withColumns({
        name: F.coalesce(fn(col).over(before), F.lit(0)) for name, (fn, col) in values.items()
    })


def ranked(df: DataFrame, group: list[str], bucket: list[str], order: list, name: str) -> DataFrame:
    """row_number over (group order by bucket, order)."""
    keys = group + bucket
    offsets = _offsets(df.groupBy(*keys).agg(F.count("*").alias("_n")), group, bucket,
                       {"_before": (F.sum, "_n")}).drop("_n")
    within = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _join(within, offsets, keys).withColumn(
        name, F.col("_rn") + F.col("_before")).drop("_rn", "_before")


def running_sum(df: DataFrame, group: list[str], bucket: list[str], order: list,
                sums: dict[str, Column]) -> DataFrame:
    """Running totals, the current row included, over (group order by bucket, order)."""
    keys = group + bucket
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = df.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = _offsets(totals, group, bucket,
                       {f"_o_{n}": (F.sum, f"_t_{n}") for n in sums}).drop(
        *[f"_t_{n}" for n in sums])
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(upto) for n in sums})
    out = _join(within, offsets, keys)
    return out.withColumns({n: F.col(f"_w_{n}") + F.col(f"_o_{n}") for n in sums}).drop(
        *[f"_{p}_{n}" for n in sums for p in "vwo"])


def running_balance(df: DataFrame, group: list[str], bucket: list[str], order: list,
                    step: Column) -> DataFrame:
    """Running sum of `step` and its running minimum (never above zero), before and after each row.

    Adds balance (after), floor (minimum so far, this row included) and floor_before.
    """
    keys = group + bucket
    df = df.withColumn("_s", step)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumn("_b", F.sum("_s").over(upto)).withColumn("_m", F.min("_b").over(upto))
    totals = within.groupBy(*keys).agg(F.sum("_s").alias("_t"), F.min("_m").alias("_low"))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .withColumn("_abs", F.col("_o") + F.col("_low"))
        .withColumn("_f", F.least(F.coalesce(F.min("_abs").over(before), F.lit(0)), F.lit(0)))
        .select(*keys, "_o", "_f")
    )
    out = _join(within, offsets, keys).withColumns({
        "balance": F.col("_b") + F.col("_o"),
        "floor": F.least(F.col("_m") + F.col("_o"), F.col("_f")),
    })
    before_row = Window.partitionBy(*keys).orderBy(*order)
    return out.withColumn("floor_before", F.coalesce(F.lag("floor").over(before_row), "_f")).drop(
        "_s", "_b", "_m", "_o", "_f")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Add the offsets. The rows are already distributed and sorted by the keys, so only the small side moves; it
    grows with the groups, so it isn't broadcast. A null key meets no offset and stops the job; no row is lost."""
    offset = next(c for c in right.columns if c not in keys)
    missing = F.raise_error(F.lit(f"null in one of {keys}")).cast(right.schema[offset].dataType)
    return left.join(right.hint("merge"), keys, "left").withColumn(offset, F.coalesce(offset, missing))
