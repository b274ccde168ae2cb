"""Secret scans over history: an incremental ledger of contents and rule versions.

Every historical version of a file is addressed by the SHA-256 of its content. A content is scanned
once for each version of each rule, however many paths and versions hold it and however often the scan
is repeated: pairs of content and rule version that the ledger has are skipped. Findings then join back
to every path. Only DataFrame and SQL functions are used.

Cases: null content is an empty text, which is a content like others. Rows that repeat a path and
content all get the findings. A null doc_id is a path like others. A content without findings is in the
ledger too, with empty lists. An empty table gives an empty result. Extra columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import persisted
from staycheck.llm.spans import PLACE, find

LEDGER = "blob binary, rule string, version int, found array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """keep: SQL over a match x that says whether it counts."""
    name: str
    pattern: str
    version: int = 1
    keep: str = "true"


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the patterns of the first three rules are fixed values; the runs are written so that each is looked at once
RULES = (
    Rule("assign", _ASSIGN.replace("'", "\\x27"),
         keep="length(regexp_extract(x.match, {pattern}, 1)) >= 8"),
    Rule("access", "AKIA[A-Z0-9]{12,}+"),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hosting", "gh[opsu]_[A-Za-z0-9]{36,}+"),
)
BASE = ("assign", "access", "hex")


def contents(history: DataFrame) -> DataFrame:
    """(doc_id, blob, text): each version with the address of its content."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return history.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))


def unseen(history: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, text, due): each content that some rule version hasn't seen, once, and those rules.

    Texts move only to meet the path that stands for their content, by (path, content), so the many
    paths of one content don't meet in one task."""
    rows = contents(history)
    known = F.array(*[F.lit(r.name) for r in rules])
    blobs = rows.groupBy("blob").agg(F.min("doc_id").alias("path")).withColumn("due", known)
    if ledger is not None:
        versions = ledger.sparkSession.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
        done = ledger.join(F.broadcast(versions), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(done, "blob", "left").select(
            "blob", "path", F.array_except("due", F.coalesce("done", F.array().cast("array<string>"))).alias("due")
        ).where(F.size("due") > 0)
    blobs = blobs.select(F.col("blob").alias("address"), "path", "due")
    return rows.join(blobs, F.expr("blob = address AND doc_id <=> path")).select("blob", "text", "due")


def scan(due: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for contents and the rules they are due for."""
    found = []
    for r in rules:
        keep = r.keep.replace("{pattern}", "r'" + r.pattern + "'")
        places = f"filter({find('text', r.pattern)}, x -> {keep})"
        found.append(f"named_struct('rule', '{r.name}', 'version', {r.version}, 'found', IF(array_contains(due, '{r.name}'), "
                     f"{places}, cast(null AS array<{PLACE}>)))")
    rows = due.select("blob", F.expr(f"filter(array({', '.join(found)}), r -> r.found IS NOT NULL)").alias("all"))
    rows = rows.select("blob", F.explode("all").alias("r"))
    return rows.select("blob", "r.rule", "r.version", F.expr(
        "transform(r.found, x -> struct(x.start, x.end))").alias("found")).dropDuplicates(["blob", "rule", "version"])


def scan_history(history: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): per row of history doc_id, blob and its findings, an array of rule, rank,
    start, end (end exclusive, code points); and the ledger with what was scanned now."""
    news = persisted(scan(unseen(history, ledger, rules), rules))
    whole = news if ledger is None else ledger.unionByName(news)
    rank = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.name, n)])
    wanted = " OR ".join(f"(rule = '{r.name}' AND version = {r.version})" for r in rules)
    spans = whole.where(wanted).where(F.size("found") > 0).select(
        "blob", F.col("rule").alias("kind"), rank[F.col("rule")].alias("rank"), F.explode("found").alias("f"))
    by_blob = persisted(spans.groupBy("blob").agg(
        F.collect_list(F.struct("kind", "rank", "f.start", "f.end")).alias("spans")))
    rows = contents(history).drop("text")
    none = F.array().cast("array<struct<kind: string, rank: int, start: int, end: int>>")
    return rows.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), whole
