"""Metric keys: metric:period[:dimension=value]."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.periods import is_valid_period


def render_key(metric: Column, period: Column, dimension: Column, value: Column) -> Column:
    return F.concat_ws(":", metric, period, F.when(
        dimension.isNotNull(), F.concat(dimension, F.lit("="), value)))


def parse_key(key: Column) -> dict[str, Column]:
    parts = F.split(key, ":")
    seg = F.get(parts, F.lit(2))
    return {
        "metric": F.get(parts, F.lit(0)),
        "period": F.get(parts, F.lit(1)),
        "dimension": F.when(seg.isNotNull(), F.regexp_extract(seg, "^([^=]*)", 1)),
        "value_key": F.when(seg.contains("="), F.regexp_extract(seg, "^[^=]*=(.*)$", 1)),
    }


def key_problem(metric: Column, period: Column, dimension: Column, value: Column) -> Column:
    """Why a key is not one, or null."""
    needs = metric == "guests_by_nationality"
    return (
        F.when(~F.coalesce(metric.isin(*values.METRICS), F.lit(False)), "unknown_metric")
        .when(~is_valid_period(period), "bad_period")
        .when(dimension.isNull() != value.isNull(), "half_dimension")
        .when(needs & dimension.isNull(), "dimension_required")
        .when(~needs & dimension.isNotNull(), "dimension_not_allowed")
        .when(dimension.isNotNull() & (dimension != values.DIMENSION), "unknown_dimension")
        .when(value.isNotNull() & ~value.rlike("^[A-Z]{2}$"), "not_iso2")
    )


def is_percentage(metric: Column) -> Column:
    return metric == "occupancy_pct"


def within_tolerance(difference: Column, metric: Column, percentage: str = values.PERCENTAGE_TOLERANCE) -> Column:
    """Symmetric: percentages within the absolute band, everything else exact."""
    band = F.when(is_percentage(metric), F.lit(percentage)).otherwise("0")
    return F.abs(difference) <= band.cast("decimal(38,10)")
