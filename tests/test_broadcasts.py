"""Rows that Spark takes for few, expanded or packed ones, meet by sort and merge and not in a broadcast."""

import uuid

from pyspark.sql import functions as F

from staycheck.operators import ranking, review, scoring, workbook
from tests.test_scale import plan


def packed(tmp_path, df):
    """df read back from a file, whose size Spark goes by."""
    df.write.parquet(path := str(tmp_path / uuid.uuid4().hex))
    return df.sparkSession.read.parquet(path)


def test_days_a_finding_may_cite_are_not_broadcast(spark, tmp_path):
    findings = packed(tmp_path, spark.createDataFrame(
        [("H-1", "F-0001", "inventory", "a.csv", None, 1, 33, "A1"), ("H-1", "F-0002", "inventory", "a.csv", None, 33, 34, "A1"),
         ("H-2", "F-0001", "inventory", "b.csv", None, 1, 1, "A1"), ("H-2", "F-0002", "pdf", "r.pdf", 1, 1, 2, None),
         ("H-2", "F-0003", "pdf", "r.pdf", 2, 1, 1, None), ("H-3", "F-0001", "not_reached", None, None, None, None, None)],
        "submission_id string, finding_id string, source_kind string, source_file string, source_page int, "
        "source_row_start int, source_row_end int, cell string"))
    rows = spark.createDataFrame([("H-2", "r.pdf", 1, 1), ("H-2", "r.pdf", 1, 2)], "submission_id string, file string, page int, row_no int")
    files = packed(tmp_path, spark.createDataFrame([("H-1", "a.csv"), ("H-2", "a.csv")], "submission_id string, file string"))
    days = files.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.lit(90)))).filter("row_no <> 34")
    found = scoring.openable(findings, packed(tmp_path, rows), days)
    assert "BroadcastHashJoin" not in plan(found)
    assert {(r.submission_id, r.finding_id): r.openable for r in found.collect()} == {
        ("H-1", "F-0001"): True, ("H-1", "F-0002"): False, ("H-2", "F-0001"): False, ("H-2", "F-0002"): True,
        ("H-2", "F-0003"): False, ("H-3", "F-0001"): False}


def test_findings_of_narratives_are_not_broadcast(spark, tmp_path):
    findings = packed(tmp_path, spark.createDataFrame([("H-1", "F-0001", "P-1", ["P-2"]), ("H-1", "F-0002", None, [])],
                                     "submission_id string, finding_id string, explaining_permutation string, also_explained_by array<string>"))
    told = findings.select("submission_id", "finding_id").withColumns({
        "echoed_id": F.col("finding_id"), "cites_permutation": F.lit("P-2"), "sentence": F.lit("x"), "grounded": F.lit(True),
        **{c: F.lit(False) for c in ("leaks_a_number", "names_an_unassigned_cause", "reads_as_an_accusation")}})
    found = review.narrative_problems(told, findings)
    assert "BroadcastHashJoin" not in plan(found)
    assert [(r.finding_id, r.problems) for r in found.collect()] == [("F-0002", ["unassigned_cause"])]


def test_offsets_of_groups_are_not_broadcast(spark, tmp_path):
    rows = packed(tmp_path, spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("a", 1, 4), ("b", 1, 9)], "g string, b int, k int"))
    numbered = ranking.ranked(rows, ["g"], ["b"], ["k"], "n")
    assert "BroadcastHashJoin" not in plan(numbered)
    assert sorted((r.g, r.n, r.k) for r in numbered.collect()) == [("a", 1, 4), ("a", 2, 5), ("a", 3, 1), ("b", 1, 9)]


def test_columns_of_ranges_are_not_broadcast(spark, tmp_path):
    blocks = packed(tmp_path, spark.createDataFrame(
        [("H-1", "1", "N", "guests_by_nationality", "periods_across_columns", "B5:D6", "B4:D4", "nationality_iso2", "A5:A6", None),
         ("H-2", "1", "N", "guests_by_nationality", "periods_across_columns", "B5:B5", "B4:B4", "nationality_iso2", "A5:A5", None)],
        "submission_id string, block_id string, sheet string, metric string, orientation string, value_range string, "
        "period_label_range string, named_dimension string, dimension_label_range string, dimension_total_range string"))
    cells = packed(tmp_path, spark.createDataFrame(
        [("H-1", "N", r, c) for r in range(4, 8) for c in range(1, 6)] + [("H-2", "N", 5, 2), ("H-2", "O", 5, 2), ("H-3", "N", 5, 2), (None, "N", 5, 2)],
        "submission_id string, sheet string, row int, col int"))
    resolved = blocks.withColumns({role: workbook.parse_rect(F.col(column)) for role, column in workbook.RANGES.items()})
    found = workbook.mapped_cells(cells, resolved, list(workbook.RANGES))
    assert "BroadcastHashJoin" not in plan(found)
    got = sorted((r.submission_id, r.role, r.row, r.col, r.down, r.across) for r in found.collect())
    assert got == sorted(
        [("H-1", "value", r, c, r - 5, c - 2) for r in (5, 6) for c in (2, 3, 4)] + [("H-1", "period", 4, c, 0, c - 2) for c in (2, 3, 4)]
        + [("H-1", "dimension", r, 1, r - 5, 0) for r in (5, 6)] + [("H-2", "value", 5, 2, 0, 0)])


def test_labels_of_cells_are_not_broadcast(spark, tmp_path):
    blocks = packed(tmp_path, spark.createDataFrame(
        [("H-1", "1", "N", "guests_by_nationality", "periods_across_columns", "B5:C6", "B4:C4", "nationality_iso2", "A5:A6", None)],
        "submission_id string, block_id string, sheet string, metric string, orientation string, value_range string, "
        "period_label_range string, named_dimension string, dimension_label_range string, dimension_total_range string"))
    cells = packed(tmp_path, spark.createDataFrame(
        [(4, 2, "1995-01", None), (4, 3, "1995-Q1", None), (5, 1, "Germany", None), (6, 1, "Nowhere", None), (5, 2, None, 7), (5, 3, None, 8), (6, 2, None, 9)],
        "row int, col int, text string, number int")).select(
            F.lit("H-1").alias("submission_id"), F.lit("N").alias("sheet"), "row", "col", "text", F.col("number").cast("decimal(38,10)").alias("number"),
            F.lit("General").alias("number_format"), F.when(F.col("number").isNotNull(), "number").otherwise("text").alias("value_type"))
    resolved = workbook.resolve_blocks(blocks, workbook.sheet_extents(cells))
    index = spark.createDataFrame([("country", "germany", "DE")], "kind string, alias_key string, code string")
    read = workbook.read_claims(cells, resolved, index)
    assert "BroadcastHashJoin [submission_id" not in plan(read)
    assert sorted((r.kind, r.metric_key or "", int(r.value or 0), r.cell, r.problem) for r in read.collect()) == [
        ("claim", "guests_by_nationality:1995-01:nationality_iso2=DE", 7, "B5", None),
        ("claim", "guests_by_nationality:1995-Q1:nationality_iso2=DE", 8, "C5", None), ("defect", "", 0, "A6", "unmappable_label")]
