"""Time the headline queries; prints one JSON line.

Inputs a user would already have on disk (reservations, inventory, claims, report words) are laid
out as tables first and not timed. Every query is run once to warm up and then timed once.
"""

import json
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    from staycheck.operators import checks, evidence, metrics, reconcile, reports, runlog
    from staycheck.functions.text import redact
    from staycheck.plans import adapters as a
    from staycheck.plans.verify import verify
    from staycheck.session import build_session
    from staycheck.sources.rulesets import rulesets
    from pyspark.sql import functions as F

    spark = build_session(f"local[{CPUS}]", CPUS, **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.files.maxPartitionBytes": str(16 << 20)})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="bench-")

    def table(name, df):
        path = f"{root}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    res = table("reservations", a.reservation_rows(spark, SF_DIR))
    inv = table("inventory", a.inventory(spark, SF_DIR))
    declared = table("declared", a.declared_periods(spark, SF_DIR))
    claims = table("claims", a.claims(metrics.metric_values(res, inv, declared)))
    printed = table("printed", a.printed_rows(spark, SF_DIR))
    blocks = table("totals", a.totals_blocks(printed))
    words = table("words", a.report_words(a.printed_cells(printed)))
    nodes = table("nodes", a.node_log(spark, SF_DIR))
    calls = table("calls", a.call_log(spark, SF_DIR))
    documents = a.table(spark, SF_DIR, "documents")
    found = table("findings", verify(res, inv, claims, declared)["findings"])

    def findings():
        pairs = reconcile.pair(claims, metrics.metric_values(res, inv, declared))
        return reconcile.to_findings(reconcile.classify(reconcile.with_explanations(pairs)))

    jobs = {
        "recompute_one_ruleset": lambda: metrics.metric_values(res, inv, declared, rulesets()[:1]),
        "recompute_all_rulesets": lambda: metrics.metric_values(res, inv, declared),
        "reconcile_findings": findings,
        "verify_end_to_end": lambda: verify(res, inv, claims, declared)["verdicts"],
        "evidence_ranges": lambda: evidence.evidence(found, res, inv),
        "words_to_rows": lambda: checks.parse_printed(reports.data_lines(words, a.ID_PATTERN)),
        "reconcile_totals": lambda: reports.reconcile_totals(printed, reports.parse_totals(blocks)),
        "merge_reports": lambda: reports.merge_reports(printed),
        "node_timeline": lambda: runlog.timeline(runlog.pair_nodes(nodes)),
        "attribute_calls": lambda: runlog.attribute_calls(runlog.pair_nodes(nodes), calls),
        "redact_documents": lambda: documents.select("doc_id", redact(F.col("text")).alias("t")),
    }
    only = sys.argv[1:]
    times = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        for _ in range(2):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    rows = res.count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "reservations": rows,
        "reservations_per_sec_14_rulesets": round(rows / times["recompute_all_rulesets"])
        if "recompute_all_rulesets" in times else None,
        "cpus": CPUS, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
