"""Landed files to verdicts: the planted fixtures and faulty files of one batch, each submission for itself."""

import pytest
from pyspark.sql import functions as F

from staycheck import values
from staycheck.operators import metrics, reports, scoring
from staycheck.plans import adapters as a
from staycheck.plans.submission import Landed, verify_landed
from tests.test_verify import frames, random_stays

MONTHS = ("2026-01", "2026-02", "2026-03")
PERIOD = "2026-Q1"
DE = "guests_by_nationality:2026-01:nationality_iso2=DE"
# 3 and 7 stand for the faults the adapter plants in a workbook, so they are left out
STATUS = {"H-1": "PASS", "H-2": "FAIL", "H-4": "ESCALATED", "H-5": "FAIL", "H-6": "PASS", "H-8": "HALTED", "H-9": "HALTED",
          "H-10": "REJECTED", "H-12": "REJECTED", "H-13": "HALTED", "H-14": "HALTED"}


@pytest.fixture(scope="module")
def batch(spark):
    stays = [(s, *x[1:2], s, *x[3:]) for s in STATUS for x in random_stays(220, 7)]
    res, inv, declared = frames(spark, stays)
    found = metrics.metric_values(res, inv, declared).cache()
    n = F.col("submission_id")

    listed = reports.listed_rows(res).filter(F.col("month").isin(*MONTHS))
    listed = listed.withColumns({"order_no": F.substring("reservation_id", 2, 9).cast("long"), "k": F.when((n == "H-14") & (F.col("reservation_id") == "r5"), 71).otherwise(1)})
    rows = a.laid_out(listed).cache()
    cells = a.printed_cells(rows)
    # H-9 prints a rate code nobody knows, H-13 another party on the later report, H-14 one id twice
    later = cells.join(rows.filter("not arrives").select("submission_id", "reservation_id", "file"), ["submission_id", "reservation_id", "file"], "left_semi")
    odd = later.filter(n == "H-13").limit(1).select("submission_id", "reservation_id", "file").withColumn("odd", F.lit(True))
    cells = cells.join(F.broadcast(odd), ["submission_id", "reservation_id", "file"], "left").withColumns({
        "rate_code": F.when((n == "H-9") & (F.col("reservation_id") == "r5"), "VIP").otherwise(F.col("rate_code")),
        "adults": F.when(F.col("odd"), "9").otherwise(F.col("adults"))})
    words = a.report_words(cells)
    totals = a.printed_totals(reports.extracted_totals(rows.filter("copy = 1")), F.lit(1))

    figures = a.baseline_claims(found)
    columns = ["submission_id", "metric", "period", "dimension", "value_key", "value"]
    kept = figures.filter(~n.isin("H-2", "H-4", "H-5")).select(*columns)
    for sub, kind, target, more in (("H-2", "transpose_digits", F.col("metric_key") == DE, {}),
                                    ("H-4", "recompute_under", F.col("metric") == "occupancy_pct", {"permutation": "P-OCC-DENOM-ROOMS"}),
                                    ("H-5", "delete_dimension", F.col("value_key") == "KZ", {})):
        kept = kept.unionByName(scoring.mutate_claims(figures.filter(n == sub), kind, target, **more).select(*columns))
    filed = a.in_cells(kept).cache()
    book, blocks, cover = a.landed_workbook(filed, PERIOD, F.lit(False))
    kz = next(c for c in values.COUNTRIES if c[0] == "KZ")
    book = book.withColumn("text", F.when((F.col("text") == kz[2]) & (n == "H-6"), f" {kz[1].lower()} ").when(
        (F.col("text") == kz[2]) & (n == "H-8"), "Mongolia").otherwise(F.col("text")))

    names = [f"pms_{m}.pdf" for m in MONTHS] + [f"claims_{PERIOD}.xlsx", f"inventory_{PERIOD}.csv"]
    files = [(s, name, "x") for s in STATUS for name in names if (s, name[:6]) != ("H-10", "claims")]
    inv = inv.withColumn("hotel_id", F.when((n == "H-12") & (F.dayofmonth("day") == 9), "other").otherwise(F.col("hotel_id"))).withColumns({
        "file": F.lit(f"inventory_{PERIOD}.csv"), "row_no": F.dayofyear("day").cast("int")})
    of = [(s, s, PERIOD) for s in STATUS]
    landed = Landed(spark.createDataFrame(files, "submission_id string, name string, content string"),
                    spark.createDataFrame(of, "submission_id string, hotel_id string, period string"), declared, words, totals,
                    book, blocks, cover, inv)
    out = verify_landed(landed, id_pattern="^r[0-9]+$")
    return {k: out[k].collect() for k in ("verdicts", "findings", "problems", "rejected", "summary", "out_of_scope")}


def test_every_submission_has_its_status(batch):
    assert {r["submission_id"]: r["status"] for r in batch["verdicts"]} == STATUS
    assert {r["submission_id"]: r["rejection_reason"] for r in batch["rejected"]} == {
        "H-10": "unreadable_file", "H-12": "hotel_mismatch"}
    assert {(r["submission_id"], r["problem"], r["subject"]) for r in batch["problems"]} == {
        ("H-10", "unreadable_file", "claims_2026-Q1.xlsx"), ("H-12", "hotel_mismatch", "other")}


def test_findings_name_their_stage_and_source(batch):
    by = {}
    for f in batch["findings"]:
        by.setdefault(f["submission_id"], []).append(f)
    assert set(by) == {"H-2", "H-4", "H-5", "H-8", "H-9", "H-13", "H-14"}
    assert {f["metric_key"] for f in by["H-2"]} == {DE, DE.replace("2026-01", PERIOD)}
    assert all((f["variance_class"], f["source_kind"], f["stage"]) == ("V1", "pdf", 2) and f["source_file"] == "pms_2026-01.pdf"
               for f in by["H-2"])
    assert {f["explaining_permutation"] for f in by["H-4"]} == {"P-OCC-DENOM-ROOMS"} and len(by["H-4"]) == 4
    assert {(f["variance_class"], f["clause"], f["cell"]) for f in by["H-5"]} == {("V5", "D-MAT-04", None)} and len(by["H-5"]) == 4
    assert [(f["clause"], f["stage"], f["sheet"], f["detail"], f["source_kind"]) for f in by["H-8"]] == [
        ("D-NAT-12", 1, "Nationality", "Mongolia", "not_reached")]
    assert {f["clause"] for f in by["H-9"]} <= {"D-QUAL-03", "D-QUAL-01", "D-NAT-07", "D-RNS-04"}
    vip = [f for f in by["H-9"] if f["clause"] == "D-QUAL-03"]
    assert vip and all(f["detail"] == "r5 unmapped_rate_code" and f["source_kind"] == "pdf" and f["source_row_start"] for f in vip)
    assert [(f["clause"], f["detail"].split()[1]) for f in by["H-13"]] == [("D-RNS-03", "adults")]
    twice = [f for f in by["H-14"] if f["clause"] == "D-QUAL-07"]
    assert twice and all(f["detail"] == "r5 printed 2 times" for f in twice)
    assert all(f["finding_id"].startswith("F-") for f in batch["findings"])


def test_what_reading_counts(batch):
    unmapped = {r["submission_id"]: r["unmapped_labels"] for r in batch["summary"]}
    assert unmapped["H-9"] >= 1 and not any(v for k, v in unmapped.items() if k != "H-9")
    assert "H-10" not in unmapped and {r["metric"] for r in batch["out_of_scope"]} == {"average_daily_rate"}
