"""Pair claims with computed values and classify what differs.

One full outer join on (submission, metric key). The values of every alternative ruleset travel as
a short array on the computed side, so finding an explanation is an array filter, not another join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck import values
from staycheck.functions.keys import within_tolerance
from staycheck.operators.ranking import ranked

KEY = ["submission_id", "metric_key"]
SHARED = ["metric", "period", "dimension", "value_key"]


def duplicate_claims(claims: DataFrame, by: list[str]) -> DataFrame:
    """Claims that share a key (or a cell): the workbook states two figures for one thing."""
    return claims.groupBy(*by).agg(
        F.count("*").alias("claims"), F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    ).filter("claims > 1")


def accepted_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims whose key is stated once, and a blocking finding for every key stated more often: which
    of its figures was meant is not ours to choose.

    Keys meet by hash first, so the exact count runs on the few claims that can share one."""
    place = F.xxhash64("submission_id", "metric_key")
    hashes = claims.select(place.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1")
    maybe = claims.withColumn("_h", place).join(hashes.select("_h"), "_h", "left_semi")
    twice = maybe.groupBy("submission_id", "metric_key").agg(
        F.count("*").alias("_n"), F.min("metric").alias("metric"), F.min("period").alias("period")).filter("_n > 1")
    refused = twice.select(
        "submission_id", "metric_key", "metric", "period", F.lit("V7").alias("variance_class"),
        F.lit("blocking").alias("severity"), F.lit("human_review").alias("escalates_to"),
        F.lit("D-QUAL-07").alias("clause"), F.lit(1).alias("stage"),
        F.format_string("%d claims", "_n").alias("detail"))
    return claims.join(twice.select("submission_id", "metric_key"),
                       ["submission_id", "metric_key"], "left_anti"), refused


def pair(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """matched, orphan_claim, missing_claim or not_verifiable per key; not_verifiable wins."""
    c = claims.select(*KEY, *SHARED, F.col("value").alias("claimed"), "sheet", "cell")
    left = c.select(*[F.col(k).alias(f"c_{k}") for k in KEY + SHARED], "claimed", "sheet", "cell")
    joined = left.join(metrics, (F.col("c_submission_id") == F.col("submission_id"))
                       & (F.col("c_metric_key") == F.col("metric_key")), "full_outer")
    out = joined.withColumns({
        k: F.coalesce(f"c_{k}", k) for k in KEY + SHARED
    }).drop(*[f"c_{k}" for k in KEY + SHARED])
    pairing = (
        F.when(F.col("nv_reason").isNotNull(), "not_verifiable")
        .when(F.col("claimed").isNotNull() & F.col("computed").isNotNull(), "matched")
        .when(F.col("claimed").isNotNull(), "orphan_claim")
        .when(F.col("computed").isNotNull(), "missing_claim")
    )
    # keys only an alternative ruleset produces, and nobody claimed, are not pairs
    return out.withColumn("pairing", pairing).filter("pairing is not null")


def with_explanations(pairs: DataFrame, percentage: str = values.PERCENTAGE_TOLERANCE) -> DataFrame:
    """Alternatives reproducing a claim the baseline does not, in committed order."""
    off = ~F.coalesce(_inside(percentage), F.lit(False))
    found = F.filter("permuted", lambda p: within_tolerance(
        F.col("claimed") - p["value"], F.col("metric"), percentage))
    ids = F.transform(found, lambda p: p["ruleset_id"])
    return pairs.withColumn(
        "explained_by", F.when(F.col("claimed").isNotNull() & off, F.coalesce(ids, F.array())
                               ).otherwise(F.array().cast("array<string>")))


def _inside(percentage: str) -> Column:
    return within_tolerance(F.col("claimed") - F.col("computed"), F.col("metric"), percentage)


def classify(pairs: DataFrame, percentage: str = values.PERCENTAGE_TOLERANCE) -> DataFrame:
    """variance_class by the ladder; null only for an exact match or a stated non-result."""
    inside = F.coalesce(_inside(percentage), F.lit(False))
    both = F.col("pairing") == "matched"
    rung = {
        "V7": F.col("pairing") == "not_verifiable",
        "V2": F.size("explained_by") > 0,
        "V5": F.col("pairing").isin("missing_claim", "orphan_claim"),
        "V1": both & ~inside,
        "V6": both & inside,
    }
    quiet = (both & (F.col("claimed") == F.col("computed"))) | (
        rung["V7"] & F.col("claimed").isNull())
    chain = F.when(F.coalesce(quiet, F.lit(False)), F.lit(None).cast("string"))
    for name, *_ in values.CLASS_RULES:
        chain = chain.when(rung[name], name)
    chain = chain.otherwise(F.raise_error(F.concat(
        F.lit("unclassified variance: "), F.col("metric_key"))).cast("string"))
    return pairs.withColumn("variance_class", chain)


def class_setting(position: int, class_rules=values.CLASS_RULES) -> Column:
    """severity (2), proposes a correction (3) or escalates to (4) by class."""
    table = F.create_map(*[x for row in class_rules
                           for x in (F.lit(row[0]), F.lit(row[position]))])
    return table[F.col("variance_class")]


def clause() -> Column:
    return (
        F.when((F.col("variance_class") == "V7")
               & (F.col("nv_reason") == "missing_inventory_reference"), "D-RNA-04")
        .when(F.col("variance_class") == "V7", "D-CLS-01")
        .when(F.col("variance_class") == "V2", "D-CLS-07")
        .when(F.col("pairing") == "orphan_claim", "D-MAT-05")
        .when(F.col("variance_class") == "V5", "D-MAT-04")
        .when(F.col("variance_class") == "V1", "D-CLS-04")
        .when(F.col("variance_class") == "V6", "D-TOL-04")
    )


def to_findings(classified: DataFrame, class_rules=values.CLASS_RULES) -> DataFrame:
    """One finding per classified pair, informational ones included."""
    difference = F.col("claimed") - F.col("computed")
    named = F.when(F.col("variance_class") == "V2", F.col("explained_by"))
    others = F.slice(named, F.lit(2), F.greatest(F.size(named) - 1, F.lit(1)))
    return classified.filter("variance_class is not null").select(
        "submission_id", "metric_key", "metric", "period", "dimension", "value_key",
        "variance_class",
        class_setting(2, class_rules).alias("severity"),
        class_setting(4, class_rules).alias("escalates_to"),
        "claimed", "computed",
        difference.cast("decimal(38,10)").alias("difference"),
        F.when(class_setting(3, class_rules), F.col("computed")).alias("proposed_correction"),
        F.get(named, F.lit(0)).alias("explaining_permutation"),
        F.coalesce(others, F.array().cast("array<string>")).alias("also_explained_by"),
        "sheet", "cell",
        clause().alias("clause"),
        F.lit(2).alias("stage"),
    )


def not_verifiable(pairs: DataFrame) -> DataFrame:
    """Keys nobody claimed and nothing could verify: stated non-results, not findings."""
    return pairs.filter("pairing = 'not_verifiable' and claimed is null").select(
        "submission_id", "metric_key", "nv_reason")


def raised(findings: DataFrame) -> DataFrame:
    return findings.filter("severity <> 'informational'")


def with_finding_ids(findings: DataFrame) -> DataFrame:
    """F-0001.. per submission (more digits where there are more findings): clerical findings by
    stage, then definitional ones; several on one key by clause, place and detail."""
    ties = [c for c in ("clause", "sheet", "cell", "detail") if c in findings.columns]
    df = findings.withColumns({
        "is_v2": (F.col("variance_class") == "V2").cast("int"),
        "_prefix": F.substring_index("metric_key", "=", 1),
        "_place": F.concat_ws("\t", *ties),
    })
    df = ranked(df, ["submission_id"], ["is_v2", "stage", "_prefix"], ["metric_key", "_place"], "_n")
    return df.withColumn("finding_id", F.format_string("F-%04d", "_n")).drop(
        "_n", "_prefix", "_place", "is_v2")


def finding_problems(findings: DataFrame) -> DataFrame:
    """Findings that break a rule every finding must keep, with the rules broken."""
    cls, col = F.col("variance_class"), F.col
    no_cell, no_source = col("cell").isNull(), col("source_kind") == "not_reached"
    absent_ok = (cls == "V7") | ((cls == "V5") & col("claimed").isNull())
    one_sided = col("claimed").isNull() | col("computed").isNull()
    rules = {
        "cell_required": no_cell & ~absent_ok,
        "cites_nothing": no_cell & no_source,
        "v2_needs_source": no_source & (cls == "V2"),
        "v2_needs_permutation": (cls == "V2") & col("explaining_permutation").isNull(),
        "permutation_only_on_v2": (cls != "V2") & col("explaining_permutation").isNotNull(),
        "also_only_on_v2": (cls != "V2") & (F.size("also_explained_by") > 0),
        "permutation_repeats": F.array_contains("also_explained_by", col("explaining_permutation")),
        "correction_only_on_v1": (cls != "V1") & col("proposed_correction").isNotNull(),
        "v7_is_blocking": (cls == "V7") & (col("severity") != "blocking"),
        "v2_goes_to_policy_owner": (cls == "V2") & (col("escalates_to") != "policy_owner"),
        "no_figures": col("claimed").isNull() & col("computed").isNull() & (cls != "V7"),
        "difference_wrong": ~one_sided & ~col("difference").eqNullSafe(
            (col("claimed") - col("computed")).cast("decimal(38,10)")),
        "difference_not_allowed": one_sided & col("difference").isNotNull(),
        "bad_clause": ~col("clause").rlike("^D-[A-Z]+-[0-9]{2}$"),
    }
    return violations(findings, rules)


def violations(df: DataFrame, rules: dict[str, Column], name: str = "problems") -> DataFrame:
    """Rows with at least one true rule, and the names of all of them."""
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]),
                     lambda x: x.isNotNull())
    return df.withColumn(name, found).filter(F.size(name) > 0)
