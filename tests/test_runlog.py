"""Runs that are still going on, and budgets, on literal logs."""

import random

from staycheck.operators import evidence, runlog
from staycheck.sources.rulesets import rulesets

NODE = "run_id string, seq bigint, node string, phase string, outcome string, duration_ms bigint, model_calls bigint, input_tokens bigint, output_tokens bigint"


def nodes(spark, *rows):
    return spark.createDataFrame([(run, seq, node, phase, "ok" if phase == "exit" else "running", ms, calls, 0, 0)
                                  for run, seq, node, phase, ms, calls in rows], NODE)


def calls(spark, *rows):
    return spark.createDataFrame([(run, seq, agent, ms) for run, seq, agent, ms in rows],
                                 "run_id string, seq bigint, agent string, duration_ms bigint")


def test_an_open_run(spark):
    log = nodes(spark, ("R", 1, "intake", "enter", 0, 0), ("R", 2, "intake", "exit", 700, 1), ("R", 3, "extract", "enter", 0, 0),
                ("S", 1, "intake", "enter", 0, 0), ("S", 2, "intake", "exit", 700, 0))
    made = calls(spark, ("R", 10, "mapping", 30), ("R", 11, "mapping", 40), ("R", 12, "critic", 50),
                 ("S", 10, "mapping", 5), ("S", 11, "reviewer_assist", 6))
    timings = runlog.pair_nodes(log)
    got = runlog.attribute_calls(timings, made)
    assert {(r["run_id"], r["seq"]): r["node"] for r in got.collect()} == {
        ("R", 10): "intake", ("R", 11): "extract", ("R", 12): "extract", ("S", 10): "unattributed", ("S", 11): "review"}
    line = runlog.timeline(timings)
    at = {(r["run_id"], r["seq"]): (r["at_ms"], r["display_ms"]) for r in runlog.call_offsets(got, line).collect()}
    assert at[("R", 11)] == (700, 700) and at[("R", 12)] == (740, 950) and at[("S", 10)] == (700, 700)
    done = spark.createDataFrame([("S",)], "run_id string")
    states = {(r["run_id"], r["node"]): r["state"] for r in runlog.stage_states(line, finished=done).collect()}
    assert states[("R", "intake")] == "ok" and states[("R", "extract")] == "running"
    assert {v for (run, node), v in states.items() if run == "R" and node not in ("intake", "extract")} == {"pending"}
    assert {v for (run, node), v in states.items() if run == "S" and node != "intake"} == {"skipped"}


def test_only_granted_requests_spend(spark):
    asked = [("a", True), ("ghost", True), ("a", False), ("a", True), ("b", True), ("ghost", False), ("a", True), ("b", True), ("a", False)]
    df = spark.createDataFrame([("R", i, agent, needed) for i, (agent, needed) in enumerate(asked)],
                               "run_id string, seq bigint, agent string, needed boolean")
    got = [r["disposition"] for r in runlog.budget_audit(df, per_agent=2, per_run=9, roster=["a", "b"]).orderBy("seq").collect()]
    assert got == ["granted", "refused_unknown_agent", "skipped", "granted", "granted", "refused_unknown_agent", "refused_budget",
                   "not_reached", "not_reached"]
    per_run = runlog.budget_audit(df, per_agent=9, per_run=3, roster=["a", "b"]).filter("scope = 'per-run'").orderBy("seq").first()
    assert (per_run["seq"], per_run["disposition"]) == (6, "refused_budget")


def test_evidence_of_a_large_hotel_equals_row_by_row(spark):
    rng = random.Random(9)
    rules = rulesets()
    rows = []
    for i in range(3000):
        m = rng.randrange(1, 4)
        rows.append(("H-1" if i % 3 else f"H-{2 + i % 5}", rng.choice(["DE", "FR", None]), rng.choice(["CHECKED_OUT", "NO_SHOW", "IN_HOUSE"]),
                     rng.choice(["BAR", "HOUSE", "COMP"]), f"pms_2026-0{m}.pdf", i // 300 + 1, i % 300, f"2026-0{m}-27", f"2026-0{m}-28"))
    df = spark.createDataFrame(rows, "submission_id string, nationality_iso2 string, status string, rate_code string, file string, "
                                     "page int, row_no int, a string, d string").selectExpr(
        "*", "date_add(cast(a as date), row_no % 9) as departure_date", "cast(a as date) as arrival_date")
    asked = [("H-1", f"k{n}", "room_nights_sold", period, nat, 1, perm) for n, (period, nat, perm) in enumerate(
        [("2026-01", None, None), ("2026-Q1", None, None), ("2026-Q1", "DE", None), ("2026", "FR", rules[1].ruleset_id),
         ("2026-02", None, rules[-1].ruleset_id)])]
    findings = spark.createDataFrame(asked, "submission_id string, metric_key string, metric string, period string, value_key string, "
                                            "computed int, explaining_permutation string")
    got = {}
    for r in evidence.reservation_evidence(findings, df).collect():
        for n in range(r["row_start"], r["row_end"] + 1):
            got.setdefault(r["metric_key"], set()).add((r["file"], r["page"], n))
    by = {r.ruleset_id: r for r in rules}
    for _, key, _, period, nat, _, perm in asked:
        rule = by[perm or "BASELINE"]
        months = {"2026-01": [1], "2026-02": [2]}.get(period, [1, 2, 3] if "Q" in period else range(1, 13))
        want = set()
        for sub, who, status, rate, file, page, row, a, _ in rows:
            first, last = int(a[5:7]), int(a[5:7]) + (27 + row % 9 > (28 if a[5:7] == "02" else 31))
            if sub == "H-1" and status in rule.status_in and rate in rule.rate_in and nat in (None, who) and {first, last} & set(months):
                want.add((file, page, row))
        assert got.get(key, set()) == want, key
