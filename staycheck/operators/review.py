"""Human decisions about findings, and the answers that cite them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck import values
from staycheck.operators.reconcile import violations

FINDING = ["submission_id", "finding_id"]


def unknown_findings(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    return reviews.join(findings.select(*FINDING), FINDING, "left_anti")


def undecided(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    return findings.join(reviews.select(*FINDING).distinct(), FINDING, "left_anti")


def standing_decisions(reviews: DataFrame) -> DataFrame:
    """The last decision per finding stands; earlier ones are counted, and stay in `reviews`."""
    last = F.max_by(F.struct("decision", "reviewer", "amended_value"), "seq")
    return reviews.groupBy(*FINDING).agg(
        last.alias("d"), F.max("seq").alias("seq"), (F.count("*") - 1).alias("superseded")
    ).select(*FINDING, "d.decision", "d.reviewer", "d.amended_value", "seq", "superseded")


def superseded(reviews: DataFrame) -> DataFrame:
    last = reviews.groupBy(*FINDING).agg(F.max("seq").alias("_last"))
    return reviews.join(last, FINDING).filter("seq < _last").drop("_last")


def review_problems(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Decisions the gate refuses, with why."""
    known = findings.select(*FINDING, F.col("variance_class").alias("_class"))
    name, amend = F.trim("reviewer"), F.col("decision") == "amend"
    figure = F.col("amended_value").try_cast("decimal(38,10)")
    return violations(reviews.join(known, FINDING, "left"), {
        "no_name": name == "",
        "not_a_name": (F.length(name) > values.MAX_REVIEWER_NAME) | name.rlike(r"[\n\r]"),
        "unknown_finding": F.col("_class").isNull(),
        "bad_decision": ~F.col("decision").isin("accept", "reject", "amend"),
        "amend_needs_value": amend & F.col("amended_value").isNull(),
        "value_without_amend": ~amend & F.col("amended_value").isNotNull(),
        "not_a_figure": amend & F.col("amended_value").isNotNull() & figure.isNull(),
        "amend_only_v1": amend & (F.col("_class") != "V1"),
    })


def citation_problems(citations: DataFrame, findings: DataFrame, clauses: DataFrame,
                      policy_version: str) -> DataFrame:
    """Citations of something the run does not contain."""
    def refs(kind: str, cols: list[str], source: DataFrame) -> DataFrame:
        mine = citations.filter(F.col("kind") == kind)
        keys = ["submission_id", *cols]
        seen = source.select(*keys).distinct()
        return mine.join(seen, keys, "left_anti").withColumn("problem", F.lit(f"no such {kind}"))

    sources = findings.select(
        "submission_id", "source_kind", F.col("source_file").alias("file"),
        F.col("source_page").alias("page"), F.col("source_row_start").alias("row_start"),
        F.col("source_row_end").alias("row_end"))
    rows = ["file", "row_start", "row_end"]
    clause = citations.filter("kind = 'clause'").join(
        clauses.select("clause").distinct().withColumn("_known", F.lit(True)), "clause", "left")
    clause = clause.withColumn(
        "problem", F.when(F.col("_known").isNull(), "no such clause")
        .when(F.col("policy_version") != policy_version, "other policy version")
    ).filter("problem is not null").drop("_known")
    return (
        refs("pdf", ["page", *rows], sources.filter("source_kind = 'pdf'"))
        .unionByName(refs("inventory", rows, sources.filter("source_kind = 'inventory'")))
        .unionByName(refs("excel", ["sheet", "cell"], findings.filter("cell is not null")))
        .unionByName(clause)
    )


def narrative_problems(narratives: DataFrame, findings: DataFrame) -> DataFrame:
    """Sentences attached to the wrong finding, naming a cause nobody found, or graded down."""
    # as many as the narratives; packed as they are written, Spark may take them for few and broadcast them
    f = findings.select(*FINDING, "explaining_permutation", "also_explained_by").hint("merge")
    assigned = F.array_compact(F.concat(F.array("explaining_permutation"), "also_explained_by"))
    cites = F.col("cites_permutation")
    return violations(narratives.join(f, FINDING, "left"), {
        "misrouted": F.col("echoed_id") != F.col("finding_id"),
        "unassigned_cause": cites.isNotNull() & ~F.coalesce(
            F.array_contains(assigned, cites), F.lit(False)),
        "too_long": F.length("sentence") > values.MAX_SENTENCE,
        "ungrounded": ~F.col("grounded"),
        "leaks a number": F.col("leaks_a_number"),
        "names an unassigned cause": F.col("names_an_unassigned_cause"),
        "reads as an accusation": F.col("reads_as_an_accusation"),
    })
