"""Planted errors, what they should produce, and whether a run produced it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck.functions.keys import within_tolerance
from staycheck.functions.periods import period_kind, periods_of_month
from staycheck.functions.text import transpose_digits

GROUP = ["submission_id", "metric", "_v"]


def _with_value_slot(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", F.coalesce("value_key", F.lit("")))


def quarter_rollup(claims: DataFrame) -> DataFrame:
    """Additive month claims summed into their quarter."""
    month = F.to_date(F.concat("period", F.lit("-01")))
    months = claims.filter((period_kind(F.col("period")) == "month") & (
        F.col("metric") != "occupancy_pct"))
    return months.withColumn("period", F.get(periods_of_month(month), F.lit(1))).groupBy(
        "submission_id", "metric", "value_key", "period").agg(
        F.sum("value").alias("value"), F.count("*").alias("months"))


def mutate_claims(claims: DataFrame, kind: str, target: Column, *, new_label: str | None = None,
                  permutation: str | None = None) -> DataFrame:
    """The claim table with one kind of error planted on the target rows.

    transpose_digits and recompute_under change values, delete_dimension removes rows, relabel
    changes the printed label only. A quarter is rewritten where one of its months changed and the
    target did not name it.
    """
    target = F.coalesce(target, F.lit(False))
    if kind == "none":
        return claims
    if kind == "delete_dimension":
        return claims.filter(~target)
    if kind == "relabel":
        return claims.withColumn("label", F.when(target, new_label).otherwise(F.col("label")))
    if kind == "transpose_digits":
        refused = F.raise_error(F.concat(F.lit("cannot transpose "), F.col("metric_key")))
        new = F.coalesce(transpose_digits(F.col("value")), refused.cast("bigint"))
    elif kind == "recompute_under":
        new = F.get(F.filter("permuted", lambda p: p["ruleset_id"] == permutation),
                    F.lit(0))["value"]
    else:
        raise ValueError(f"unknown mutation {kind!r}")
    df = _with_value_slot(claims).withColumn("changed", target).withColumn(
        "value", F.when(target, new).otherwise(F.col("value")).cast("decimal(38,10)"))
    kind_ = period_kind(F.col("period"))
    month = F.to_date(F.concat("period", F.lit("-01")))
    sums = df.filter((kind_ == "month") & (F.col("metric") != "occupancy_pct")).withColumn(
        "period", F.get(periods_of_month(month), F.lit(1))).groupBy(*GROUP, "period").agg(
        F.sum("value").alias("_sum"), F.bool_or("changed").alias("_touched")).filter("_touched")
    out = df.join(sums, [*GROUP, "period"], "left")
    rewrite = F.col("_sum").isNotNull() & ~F.col("changed")
    return out.withColumn("value", F.when(rewrite, F.col("_sum")).otherwise(F.col("value")).cast(
        "decimal(38,10)")).drop("_sum", "_touched", "_v", "changed")


def derive_expected(claims: DataFrame, truth: DataFrame, mismatch_class: str) -> DataFrame:
    """What a run should report, from the claim table and the truth alone."""
    keys = ["submission_id", "metric_key"]
    c = claims.select(*keys, "metric", F.col("value").alias("claimed"))
    t = truth.select(*keys, F.col("metric").alias("_m"), F.col("value").alias("computed"))
    both = c.join(t, keys, "full_outer").withColumn("metric", F.coalesce("metric", "_m"))
    inside = within_tolerance(F.col("claimed") - F.col("computed"), F.col("metric"))
    cls = (
        F.when(F.col("claimed").isNull() | F.col("computed").isNull(), "V5")
        .when(~inside, mismatch_class))
    correction = F.when((F.col("variance_class") == "V1"), F.col("computed"))
    return both.withColumn("variance_class", cls).filter("variance_class is not null").select(
        *keys, "variance_class", "claimed", "computed",
        (F.col("claimed") - F.col("computed")).cast("decimal(38,10)").alias("difference"),
        correction.alias("proposed_correction"))


def stop_at_first_blocking(findings: DataFrame, order: str) -> DataFrame:
    """A blocking finding ends a run, so it is all that is expected of one."""
    first = findings.filter("severity = 'blocking'").groupBy("submission_id").agg(
        F.min(order).alias("_stop"))
    return findings.join(first, "submission_id", "left").filter(
        F.col("_stop").isNull() | (F.col(order) == F.col("_stop"))).drop("_stop")


FIELDS = ["variance_class", "severity", "escalates_to", "claimed", "computed", "difference",
          "proposed_correction", "explaining_permutation", "sheet", "cell"]


def score_findings(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per (fixture, list, key): missing, unexpected or compared, and the fields that
    differ. Figures compare as numbers and absent equals absent."""
    keys = ["fixture_id", "list", "metric_key"]
    o = observed.groupBy(*keys).agg(
        F.count("*").alias("seen"), F.min_by(F.struct(*FIELDS), "finding_id").alias("o"))
    e = expected.select(*keys, F.struct(*FIELDS).alias("e"))
    both = o.join(e, keys, "full_outer")
    outcome = F.when(F.col("o").isNull(), "missing").when(
        F.col("e").isNull(), "unexpected").otherwise("compared")
    differs = F.array_compact(F.array(*[
        F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"e.{f}")), f) for f in FIELDS]))
    return both.select(
        *keys, outcome.alias("outcome"),
        F.when(outcome == "compared", differs).otherwise(F.array().cast("array<string>"))
        .alias("differs"),
        F.coalesce("seen", F.lit(0)).alias("seen"),
        F.coalesce("e.severity", "o.severity").alias("severity"))


def key_set_differences(observed: DataFrame, expected: DataFrame) -> DataFrame:
    keys = ["fixture_id", "list", "metric_key"]
    o, e = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    return o.exceptAll(e).withColumn("side", F.lit("unexpected")).unionByName(
        e.exceptAll(o).withColumn("side", F.lit("missing")))


def tally(scores: DataFrame, controls: DataFrame) -> DataFrame:
    """Counts and rates over all fixtures; a rate over nothing is null, not one."""
    s = scores.join(controls.select("fixture_id", F.lit(True).alias("control")), "fixture_id",
                    "left").withColumn("control", F.coalesce("control", F.lit(False)))
    expected = F.col("outcome") != "unexpected"
    material = expected & (F.col("severity") == "material")
    matched = (F.col("outcome") == "compared") & ~F.array_contains("differs", "variance_class")
    unexpected = F.col("outcome") == "unexpected"
    t = s.agg(
        F.count_if(material).alias("material_expected"),
        F.count_if(material & matched).alias("material_matched"),
        F.count_if(expected).alias("class_expected"), F.count_if(matched).alias("class_matched"),
        F.count_if(unexpected).alias("false_positives"),
        F.count_if(unexpected & F.col("control")).alias("control_false_positives"))
    return t.withColumns({
        "recall": F.try_divide("material_matched", "material_expected"),
        "class_rate": F.try_divide("class_matched", "class_expected")})


def openable(findings: DataFrame, rows: DataFrame, inv: DataFrame) -> DataFrame:
    """submission_id, finding_id, openable: whether what a finding cites is there. A cited range is there if its
    first and last row are; a finding without a source is openable by its cell.

    Spark takes days expanded from ranges for as few as those, and rows read back for as few as they are packed, so
    that neither is broadcast by that, the joins are asked to sort and merge."""
    def ends(kind: str, place: list[str], source: DataFrame) -> DataFrame:
        mine = findings.filter(F.col("source_kind") == kind)
        there = source.select("submission_id", *place, "row_no").distinct()
        cited = mine.select("submission_id", "finding_id", *[F.col(f"source_{c}").alias(c) for c in place], F.explode(F.array_distinct(
            F.array("source_row_start", "source_row_end"))).alias("row_no"))
        return cited.join(there.hint("merge"), ["submission_id", *place, "row_no"], "left_anti")

    gone = ends("pdf", ["file", "page"], rows).select("submission_id", "finding_id").union(
        ends("inventory", ["file"], inv).select("submission_id", "finding_id")).distinct().withColumn("_gone", F.lit(True))
    reached = F.col("source_kind") != "not_reached"
    return findings.join(gone.hint("merge"), ["submission_id", "finding_id"], "left").select(
        "submission_id", "finding_id", F.when(reached, F.col("_gone").isNull()).otherwise(F.col("cell").isNotNull()).alias("openable"))


def rates(findings: DataFrame, rows: DataFrame, inv: DataFrame, graded: DataFrame) -> DataFrame:
    """Per submission: how many findings cite what is there, and how many graded narratives passed. graded:
    submission_id, finding_id, passed. A rate over nothing is null, not one."""
    cited = openable(findings, rows, inv).groupBy("submission_id").agg(
        F.count("*").alias("findings"), F.count_if("openable").alias("openable"))
    told = graded.groupBy("submission_id").agg(
        F.count("passed").alias("narratives_graded"), F.count_if("passed").alias("narratives_passed"))
    both = cited.join(told, "submission_id", "full_outer").na.fill(0)
    return both.withColumns({"openable_rate": F.try_divide("openable", "findings"),
                             "narrative_rate": F.try_divide("narratives_passed", "narratives_graded")})


def outcomes(scores: DataFrame, fixtures: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """passed only if every check of a fixture holds; a fixture with no check fails. measured: the fixtures
    (fixture_id) that have a verdict; another one is unmeasured, neither passed nor failed."""
    clean = (F.col("outcome") == "compared") & (F.size("differs") == 0) & (F.col("seen") == 1)
    per = scores.groupBy("fixture_id").agg(F.bool_and(clean).alias("ok"),
                                           F.count("*").alias("checks"))
    out = fixtures.select("fixture_id").distinct().join(per, "fixture_id", "left").select(
        "fixture_id", F.coalesce("checks", F.lit(0)).alias("checks"),
        F.when(F.coalesce("ok", F.lit(False)), "passed").otherwise("failed").alias("outcome"))
    if measured is None:
        return out
    seen = measured.select("fixture_id").distinct().withColumn("_seen", F.lit(True))
    return out.join(seen, "fixture_id", "left").withColumn(
        "outcome", F.when(F.col("_seen").isNull(), "unmeasured").otherwise(F.col("outcome"))).drop("_seen")


def sweep(scored: DataFrame) -> DataFrame:
    """One row over all outcomes: fixtures, passed, failed, unmeasured, and whether the sweep is complete. One
    without a fixture is not."""
    counts = scored.agg(F.count("*").alias("fixtures"), *[
        F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "unmeasured")])
    return counts.withColumn("complete", (F.col("fixtures") > 0) & (F.col("unmeasured") == 0))


def partition_problems(rules: DataFrame, members: list[str]) -> DataFrame:
    """Rules whose included and excluded sets overlap, or leave a member unruled."""
    every = F.array(*[F.lit(m) for m in members])
    return rules.withColumns({
        "overlap": F.array_sort(F.array_intersect("included", "excluded")),
        "unruled": F.array_sort(F.array_except(every, F.array_union("included", "excluded"))),
    }).filter((F.size("overlap") > 0) | (F.size("unruled") > 0))


def first_eligible(df: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row a rule allows."""
    return df.filter(condition).orderBy(*order).limit(1)
