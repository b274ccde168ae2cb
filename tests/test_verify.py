"""Small submissions with known answers, including the six planted fixtures."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from staycheck.operators import labels, metrics, reconcile, reports, scoring
from staycheck.operators import workbook as wb
from staycheck.plans import adapters
from staycheck.plans.verify import verify
from staycheck.sources import readers
from staycheck.sources.readers import RESERVATION
from staycheck.sources.rulesets import check_class_order, rulesets

INV = "submission_id string, hotel_id string, day date, rooms_total int, rooms_out_of_order int"


def stay(rid, arrive, depart, nat="DE", adults=2, children=1, rooms=1, status="CHECKED_OUT",
         rate="BAR", sub="H-1"):
    a, d = dt.date.fromisoformat(arrive), dt.date.fromisoformat(depart)
    n = (d - a).days
    return (sub, rid, sub, "g_00000000", nat, adults, children, rooms, n, n * rooms, a, d, status, rate)


def frames(spark, stays, inventory=True, periods=("2026-01", "2026-02", "2026-03", "2026-Q1")):
    res = spark.createDataFrame(stays, RESERVATION)
    subs = sorted({s[0] for s in stays})
    days = [dt.date(2026, 1, 1) + dt.timedelta(i) for i in range(90)]
    inv = spark.createDataFrame(
        [(s, s, d, 60, 3 if 10 <= d.day <= 12 else 0) for s in subs for d in days], INV)
    declared = spark.createDataFrame([(s, p) for s in subs for p in periods],
                                     "submission_id string, period string")
    return res, inv if inventory else None, declared


def computed(spark, stays, rules=None, **kw):
    res, inv, declared = frames(spark, stays, **kw)
    out = metrics.metric_values(res, inv, declared, rules).collect()
    return {r["metric_key"]: r for r in out}


def value(found, key):
    r = found.get(key)
    return None if r is None or r["computed"] is None else float(r["computed"])


def test_month_spanning_stay(spark):
    found = computed(spark, [stay("r1", "2026-02-28", "2026-03-03", rooms=2)])
    assert value(found, "room_nights_sold:2026-02") == 2
    assert value(found, "room_nights_sold:2026-03") == 4
    assert value(found, "room_nights_sold:2026-Q1") == 6
    assert value(found, "guests_by_nationality:2026-02:nationality_iso2=DE") == 3
    assert value(found, "guests_by_nationality:2026-03:nationality_iso2=DE") is None
    by_rule = {p["ruleset_id"]: p["value"] for p in found["room_nights_sold:2026-02"]["permuted"]}
    assert by_rule["P-MONTH-ARRIVAL"] == 6 and by_rule["P-MONTH-DEPARTURE"] == 0
    # counted once in the quarter although two of its months are occupied
    q = {p["ruleset_id"]: p["value"]
         for p in found["guests_by_nationality:2026-Q1:nationality_iso2=DE"]["permuted"]}
    assert q["P-NAT-MONTH-OCCUPIED"] == 3 and q["P-NAT-COUNTS-ROOMNIGHTS"] == 6
    assert q["P-CHILDREN-EXCLUDED"] == 2 and q["P-NAT-COUNTS-ARRIVALS"] == 1


def test_pre_period_arrival_and_day_use(spark):
    found = computed(spark, [stay("r1", "2025-12-30", "2026-01-02"),
                             stay("r2", "2026-01-05", "2026-01-05", nat="FR", rooms=2)])
    assert value(found, "room_nights_sold:2026-01") == 1
    assert value(found, "guests_by_nationality:2026-01:nationality_iso2=DE") is None
    assert value(found, "guests_by_nationality:2026-01:nationality_iso2=FR") == 3
    by_rule = {p["ruleset_id"]: p["value"] for p in found["room_nights_sold:2026-01"]["permuted"]}
    assert by_rule["P-DAYUSE-COUNTS-RN"] == 3


def test_no_inventory_and_closed_period(spark):
    found = computed(spark, [stay("r1", "2026-01-05", "2026-01-07")], inventory=False)
    assert found["occupancy_pct:2026-01"]["nv_reason"] == "missing_inventory_reference"
    assert found["room_nights_available:2026-01"]["nv_reason"] == "missing_inventory_reference"
    assert found["room_nights_sold:2026-02"]["nv_reason"] == "no_source_rows"
    late = computed(spark, [stay("r1", "2026-04-05", "2026-04-07")], periods=("2026-03", "2026-04"))
    assert value(late, "occupancy_pct:2026-04") == 0.0
    assert late["room_nights_available:2026-04"]["nv_reason"] == "no_source_rows"
    assert value(late, "occupancy_pct:2026-03") == 0.0


def test_occupancy_rounds_half_up_and_is_not_capped(spark):
    df = spark.createDataFrame([(1, 8), (4499, 4200), (0, 0), (1285, 1860), (1299, 1590),
                                (1556, 1854), (4140, 5304)], "s bigint, d bigint")
    got = [float(r[0]) for r in df.selectExpr(metrics.occupancy_sql("s", "d")).collect()]
    assert got == [12.5, 107.12, 0.0, 69.09, 81.70, 83.93, 78.05]


def random_stays(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = dt.date(2025, 12, 20) + dt.timedelta(rng.randrange(105))
        d = a + dt.timedelta(rng.choice([0, 1, 2, 3, 5, 12, 40]))
        out.append(stay(f"r{i}", str(a), str(d), rng.choice(["DE", "FR", "KZ"]), rng.randint(1, 3),
                        rng.randint(0, 2), rng.randint(1, 3),
                        rng.choice(["CHECKED_OUT", "IN_HOUSE", "CANCELLED", "NO_SHOW"]),
                        rng.choice(["BAR", "COMP", "HOUSE"])))
    return out


def test_every_alternative_equals_a_direct_recomputation(spark):
    stays = random_stays()
    all_at_once = computed(spark, stays)
    for rule in rulesets()[1:]:
        alone = computed(spark, stays, rules=[replace(rule, ord=0)])
        for key, row in all_at_once.items():
            if row["metric"] not in rule.applies_to:
                continue
            got = {p["ruleset_id"]: p["value"] for p in row["permuted"]}.get(rule.ruleset_id)
            assert (None if got is None else float(got)) == value(alone, key), (rule.ruleset_id, key)


def fixture_claims(spark, found_df):
    return adapters.baseline_claims(found_df).withColumns({
        "sheet": F.when(F.col("value_key").isNull(), "Occupancy").otherwise("Nationality"),
        "cell": F.lit("B5")})


def run(spark, claims, res, inv, declared, **kw):
    out = verify(res, inv, claims, declared, **kw)
    status = {r["submission_id"]: r["status"] for r in out["verdicts"].collect()}
    return status["H-1"], out["findings"].collect()


@pytest.fixture(scope="module")
def submission(spark):
    stays = random_stays(600, 7)
    res, inv, declared = frames(spark, stays)
    res, inv = res.cache(), inv.cache()
    return res, inv, declared, metrics.metric_values(res, inv, declared)


def test_f1_control_passes(spark, submission):
    res, inv, declared, found = submission
    assert run(spark, fixture_claims(spark, found), res, inv, declared) == ("PASS", [])


def test_f2_transposed_digits(spark, submission):
    res, inv, declared, found = submission
    claims = fixture_claims(spark, found)
    target = (F.col("metric_key") == "guests_by_nationality:2026-01:nationality_iso2=DE")
    truth = {r["metric_key"]: r["value"] for r in claims.filter("value_key = 'DE'").collect()}
    mutated = scoring.mutate_claims(claims, "transpose_digits", target)
    status, findings = run(spark, mutated, res, inv, declared)
    assert status == "FAIL"
    assert {f["metric_key"] for f in findings} == {
        "guests_by_nationality:2026-01:nationality_iso2=DE",
        "guests_by_nationality:2026-Q1:nationality_iso2=DE"}
    for f in findings:
        assert f["variance_class"] == "V1" and f["proposed_correction"] == truth[f["metric_key"]]


def test_f3_other_denominator_is_not_an_error_of_the_hotel(spark, submission):
    res, inv, declared, found = submission
    claims = scoring.mutate_claims(fixture_claims(spark, found), "recompute_under",
                                   F.col("metric") == "occupancy_pct", permutation="P-OCC-DENOM-ROOMS")
    status, findings = run(spark, claims, res, inv, declared)
    assert status == "ESCALATED" and len(findings) == 4
    assert {f["explaining_permutation"] for f in findings} == {"P-OCC-DENOM-ROOMS"}
    assert {f["escalates_to"] for f in findings} == {"policy_owner"}


def test_f4_dropped_country(spark, submission):
    res, inv, declared, found = submission
    claims = scoring.mutate_claims(fixture_claims(spark, found), "delete_dimension",
                                   F.col("value_key") == "KZ")
    status, findings = run(spark, claims, res, inv, declared)
    assert status == "FAIL" and len(findings) == 4
    assert {(f["variance_class"], f["clause"], f["cell"]) for f in findings} == {
        ("V5", "D-MAT-04", None)}


@pytest.mark.parametrize("label, status", [("Czechia", "PASS"), ("Mongolia", "HALTED")])
def test_f5_f6_relabelled_country(spark, submission, label, status):
    """The relabelled country resolves, or stops the submission before it is reconciled."""
    res, inv, declared, found = submission
    claims = scoring.mutate_claims(fixture_claims(spark, found), "relabel",
                                   F.col("value_key") == "KZ", new_label=label)
    index = labels.alias_index(labels.committed_labels(spark)).filter("kind = 'country'")
    bad = labels.normalise_labels(claims.filter("label is not null"), "label", index, "code").filter(
        "code is null").select(
        "submission_id", F.lit("room_nights_sold:2026-Q1").alias("metric_key"),
        F.lit("room_nights_sold").alias("metric"), F.lit("2026-Q1").alias("period"),
        F.lit("V7").alias("variance_class"), F.lit("blocking").alias("severity"),
        F.lit("human_review").alias("escalates_to"), "sheet", "cell",
        F.lit("D-NAT-12").alias("clause"), F.lit(1).alias("stage")).distinct()
    got, findings = run(spark, claims, res, inv, declared, upstream=bad)
    assert got == status
    assert len(findings) == (1 if status == "HALTED" else 0)


def test_rejected_submission_is_not_reconciled(spark, submission):
    res, inv, declared, found = submission
    rejected = spark.createDataFrame([("H-1", "hotel_mismatch")],
                                     "submission_id string, rejection_reason string")
    status, findings = run(spark, fixture_claims(spark, found).limit(0), res, inv, declared,
                           rejected=rejected)
    assert (status, findings) == ("REJECTED", [])


def test_orphan_explained_by_an_alternative(spark):
    """A country only house-use guests came from: no baseline key, one explaining ruleset."""
    res, inv, declared = frames(spark, [stay("r1", "2026-01-05", "2026-01-07"),
                                        stay("r2", "2026-01-05", "2026-01-07", "KZ", rate="HOUSE")])
    found = metrics.metric_values(res, inv, declared)
    key = "guests_by_nationality:2026-01:nationality_iso2=KZ"
    claim = spark.createDataFrame(
        [("H-1", "guests_by_nationality", "2026-01", "nationality_iso2", "KZ", key, "Nationality", "B9")],
        "submission_id string, metric string, period string, dimension string, value_key string, "
        "metric_key string, sheet string, cell string").withColumn(
        "value", F.lit(3).cast("decimal(38,10)"))
    pairs = reconcile.classify(reconcile.with_explanations(reconcile.pair(claim, found)))
    row = pairs.filter(F.col("metric_key") == key).first()
    assert (row["pairing"], row["variance_class"]) == ("orphan_claim", "V2")
    assert row["explained_by"] == ["P-HOUSE-INCLUDED"]


def test_rollup_with_blank_months(spark):
    def claims(march, quarter):
        rows = [("H-1", "guests_by_nationality", "2026-03", "nationality_iso2", "IS", march),
                ("H-1", "guests_by_nationality", "2026-Q1", "nationality_iso2", "IS", quarter)]
        return spark.createDataFrame(
            rows, "submission_id string, metric string, period string, dimension string, "
            "value_key string, value int")
    assert wb.rollup_mismatches(claims(3, 3)).count() == 0
    assert wb.rollup_mismatches(claims(3, 10)).count() == 1


def test_settings_are_checked():
    with pytest.raises(ValueError):
        rulesets([("P-X", "typo", ["occupancy_pct"], {"denominatorr": "rooms_available"})])
    with pytest.raises(ValueError):
        rulesets([("P-X", "bad", ["occupancy_pct"], {"denominator": "beds"})])
    with pytest.raises(ValueError):
        check_class_order(["V2", "V7", "V5", "V1", "V6"])


def test_many_findings_take_longer_ids(spark):
    df = spark.range(10001).select(
        F.lit("H-1").alias("submission_id"), F.format_string("k%05d", "id").alias("metric_key"),
        F.lit("V1").alias("variance_class"), F.lit(2).alias("stage"))
    ids = [r["finding_id"] for r in reconcile.with_finding_ids(df).orderBy("metric_key").collect()]
    assert ids[0] == "F-0001" and ids[9998:] == ["F-9999", "F-10000", "F-10001"]


def test_several_findings_on_one_key_keep_their_ids(spark):
    rows = [("H-1", "k", "V7", 0, "D-A-01", None, None, f"id {n}") for n in range(30)]
    df = spark.createDataFrame(rows, "submission_id string, metric_key string, variance_class string, stage int, "
                               "clause string, sheet string, cell string, detail string")
    named = [{r["detail"]: r["finding_id"] for r in reconcile.with_finding_ids(d).collect()}
             for d in (df, df.orderBy(F.desc("detail")).repartition(3))]
    assert named[0] == named[1] and len(set(named[0].values())) == 30


def test_only_definitional_differences_name_a_ruleset(spark):
    pair = ("H-1", "k", "room_nights_sold", "2026-01", 5.0, None, "no_source_rows", "not_verifiable", ["P-HOUSE-INCLUDED", "P-X"])
    df = spark.createDataFrame([pair], "submission_id string, metric_key string, metric string, period string, claimed double, "
                               "computed double, nv_reason string, pairing string, explained_by array<string>")
    df = df.withColumns({c: F.col(c).cast("decimal(38,10)") for c in ("claimed", "computed")}).withColumns(
        {c: F.lit(None).cast("string") for c in ("dimension", "value_key", "sheet", "cell")})
    got = reconcile.to_findings(reconcile.classify(df)).first()
    assert (got["variance_class"], got["explaining_permutation"], got["also_explained_by"]) == ("V7", None, [])


def test_repeated_claim_key_stops_only_its_submission(spark):
    stays = [stay("r1", "2026-01-05", "2026-01-07"), stay("r1", "2026-01-05", "2026-01-07", sub="H-2")]
    res, inv, declared = frames(spark, stays)
    claims = fixture_claims(spark, metrics.metric_values(res, inv, declared))
    again = claims.filter("submission_id = 'H-1' and metric = 'room_nights_sold'")
    out = verify(res, inv, claims.unionByName(again), declared)
    status = {r["submission_id"]: r["status"] for r in out["verdicts"].collect()}
    assert status == {"H-1": "HALTED", "H-2": "PASS"}
    found = out["findings"].collect()
    assert {f["submission_id"] for f in found} == {"H-1"} and all(f["detail"] == "2 claims" for f in found)


def test_a_value_against_none_is_a_conflict(spark):
    kind = "submission_id string, reservation_id string, file string, page int, row_no int, hotel_id string, rooms int, nights int"
    rows = [("H", "r1", "a", 1, 1, "H", 2, 1), ("H", "r1", "b", 1, 1, "H", None, 1), ("H", "r2", "a", 1, 2, "H", 2, 1),
            ("H", "r2", "b", 1, 2, "G", 2, 1), ("H", "r3", "a", 1, 3, None, 1, None), ("H", "r3", "b", 1, 3, None, 1, None)]
    good, bad = reports.split_merged(reports.merge_reports(spark.createDataFrame(rows, kind)))
    assert [r["reservation_id"] for r in good.collect()] == ["r3"]
    assert {r["reservation_id"]: r["conflicts"] for r in bad.collect()} == {"r1": ["rooms"], "r2": ["hotel_id"]}


def test_totals_with_repeats_and_long_figures(spark):
    left = "Room nights sold 12345678901\nRoom nights available 99999999999999999999\nOccupancy 50.00%"
    block = spark.createDataFrame([(left, "DE 3\nFR 4\nDE 5\nTotal guests 7")], "left_text string, right_text string")
    got = reports.parse_totals(block).first()
    assert got["guests"] == {"DE": 5, "FR": 4} and got["sold"] == 12345678901
    assert got["available"] is None and "available" in got["missing"]


def test_repeated_reservation_id_blocks_only_its_submission(spark):
    stays = [stay("r1", "2026-01-05", "2026-01-07"), stay("r1", "2026-01-05", "2026-01-07"),
             stay("r1", "2026-01-05", "2026-01-07", sub="H-2")]
    res, inv, declared = frames(spark, stays)
    found = metrics.metric_values(res.distinct(), inv, declared)
    out = verify(res, inv, fixture_claims(spark, found), declared)
    status = {r["submission_id"]: r["status"] for r in out["verdicts"].collect()}
    assert status == {"H-1": "HALTED", "H-2": "PASS"}
    assert [(f["finding_id"], f["clause"]) for f in out["findings"].collect()] == [
        ("F-0001", "D-QUAL-07")]


def test_inventory_rows_are_numbered_per_file(spark, tmp_path):
    from staycheck.sources.readers import read_inventory
    for hotel in ("A", "B"):
        lines = [f"{hotel},2026-01-{d:02d},60,{d % 2},{60 - d % 2}," for d in range(1, 29)]
        (tmp_path / f"inventory_{hotel}.csv").write_text(
            "hotel_id,day,rooms_total,rooms_out_of_order,rooms_available,note\n"
            + "\n".join(lines) + "\n")
    rows = read_inventory(spark, str(tmp_path)).collect()
    assert len(rows) == 56 and {r["submission_id"] for r in rows} == {"A", "B"}
    assert all(r["row_no"] == r["day"].day and r["file"] == f"inventory_{r['hotel_id']}.csv"
               for r in rows)


def test_one_file_with_another_header_stops_no_other(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffHotel_ID , day,rooms_total,rooms_out_of_order\nA,2026-01-01,60,1\n\n A,2026-01-02,60,x\n")
    (tmp_path / "b.csv").write_text('note,rooms_out_of_order,rooms_total,day,hotel_id,submission_id\n"a, b",2,50,2026-01-01,B,S\nshort\n')
    (tmp_path / "c.csv").write_text("hotel_id,day\nC,2026-01-01\n")
    (tmp_path / "d.csv").write_text("hotel_id,day,day,rooms_total,rooms_out_of_order\nD,2026-01-01,2026-01-02,9,1\n")
    (tmp_path / "e.csv").write_text("")
    got = {(r["file"], r["row_no"]): r for r in readers.read_inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.csv", 1), ("a.csv", 2), ("b.csv", 1), ("b.csv", 2)}
    assert (got["a.csv", 1]["submission_id"], got["a.csv", 1]["rooms_out_of_order"]) == ("A", 1)
    assert got["a.csv", 2]["unreadable"] == ["rooms_out_of_order"]
    b = got["b.csv", 1]
    assert (b["submission_id"], b["hotel_id"], b["rooms_total"], b["rooms_out_of_order"], b["note"]) == ("S", "B", 50, 2, "a, b")
    assert got["b.csv", 2]["day"] is None
    found = {r["file"]: (r["missing"], r["repeated"]) for r in readers.inventory_defects(spark, str(tmp_path)).collect()}
    assert found == {"c.csv": (["rooms_out_of_order", "rooms_total"], []), "d.csv": ([], ["day"])}


def test_hot_key_evidence_matches_plain_ranges(spark):
    from staycheck.operators.evidence import collapse_ranges
    rows = [(1, 1), (2, 2), (3, 3), (7, 7), (8, 9), (9, 9), (12, 12)]
    df = spark.createDataFrame([("f", a, b) for a, b in rows], "file string, a int, b int")
    got = sorted((r["row_start"], r["row_end"]) for r in collapse_ranges(df, ["file"], "a", "b").collect())
    assert got == [(1, 3), (7, 9), (12, 12)]


def test_document_diff(spark):
    from staycheck.operators.documents import diff_documents
    a = '{"x": 1, "t": {"ms": 5}, "l": [{"v": 1}, {"v": 2}], "m": [1], "only": {"deep": {"y": 1}}}'
    b = '{"x": 1.0, "t": {"ms": 9}, "l": [{"v": 1}, {"v": 3}], "m": [1, 2], "k": null}'
    df = [spark.createDataFrame([(1, d)], "id int, d string") for d in (a, b)]
    got = {(r["path"], r["why"]) for r in diff_documents(*df, "id", "d", ["t.ms"]).collect()}
    assert got == {("l[1].v", "value"), ("m", "length"), ("only", "one side only"),
                   ("k", "one side only")}


def test_unreadable_inventory_stops_only_its_submission(spark, tmp_path):
    stays = [stay("r1", "2026-01-05", "2026-01-07"), stay("r1", "2026-01-05", "2026-01-07", sub="H-2")]
    res, inv, declared = frames(spark, stays)
    claims = fixture_claims(spark, metrics.metric_values(res, inv, declared))
    day = F.col("day") == F.to_date(F.lit("2026-01-03"))
    bad = inv.filter("submission_id = 'H-1'").withColumn("rooms_out_of_order", F.when(~day, F.col("rooms_out_of_order")))
    twice = inv.filter("submission_id = 'H-2'").unionByName(inv.filter(F.col("submission_id") == "H-2").filter(day))
    for filed, stopped in ((bad.unionByName(inv.filter("submission_id = 'H-2'")), "H-1"),
                           (twice.unionByName(inv.filter("submission_id = 'H-1'")), "H-2")):
        out = verify(res, filed, claims, declared)
        status = {r["submission_id"]: r["status"] for r in out["verdicts"].collect()}
        assert status == {"H-1": "PASS", "H-2": "PASS"} | {stopped: "HALTED"}


def test_a_bad_reservation_line_is_a_defect_row(spark, tmp_path):
    names = [c.split()[0] for c in RESERVATION.split(", ")]
    good = "H-1,r1,H-1,g_1,DE,1,0,1,2,2,2026-01-05,2026-01-07,CHECKED_OUT,BAR"
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), good, good.replace(",1,0,1,", ",one,0,1,"), "H-2,r2"]) + "\n")
    assert [r["reservation_id"] for r in readers.read_reservations(spark, str(tmp_path), "csv").collect()] == ["r1"]
    found = {r["submission_id"]: r["unreadable"] for r in readers.reservation_defects(spark, str(tmp_path)).collect()}
    assert found["H-1"] == ["adults"] and len(found["H-2"]) == len(names) - 2
