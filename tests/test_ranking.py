"""Bucketed ranks and running values equal the plain ones, also with one very large group."""

import random

import pytest

from staycheck.operators.ranking import ranked, running_balance, running_sum
from staycheck.operators.runlog import pair_nodes
from pyspark.sql import functions as F


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", i, rng.choice([1, 1, -1, -1, 2]))
            for i in range(n)]


def test_ranked_and_running_sum(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, seq bigint, v bigint").withColumn(
        "b", F.expr("seq div 100"))
    got = {r["seq"]: r["n"] for r in ranked(df, ["g"], ["b"], ["seq"], "n").collect()}
    sums = {r["seq"]: r["s"] for r in running_sum(df, ["g"], ["b"], ["seq"], {"s": F.col("v")}).collect()}
    seen, total = {}, {}
    for g, seq, v in data:
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + v
        assert got[seq] == seen[g]
        assert sums[seq] == total[g]


def test_null_keys_stop_the_job(spark):
    df = spark.createDataFrame([(None, 1), ("a", 3)], "g string, seq bigint").withColumn(
        "b", F.lit(0))
    with pytest.raises(Exception, match="null in one of"):
        ranked(df, ["g"], ["b"], ["seq"], "n").collect()


def test_running_balance(spark):
    data = rows(seed=8)
    df = spark.createDataFrame(data, "g string, seq bigint, v bigint").withColumn(
        "b", F.expr("seq div 64"))
    got = {r["seq"]: (r["balance"], r["floor"], r["floor_before"])
           for r in running_balance(df, ["g"], ["b"], ["seq"], F.col("v")).collect()}
    bal, low = {}, {}
    for g, seq, v in data:
        before = low.get(g, 0)
        bal[g] = bal.get(g, 0) + v
        low[g] = min(before, bal[g])
        assert got[seq] == (bal[g], low[g], before)


def test_pairing_is_last_in_first_out(spark, monkeypatch):
    from staycheck.operators import runlog
    monkeypatch.setattr(runlog, "BLOCK", 50)
    rng = random.Random(11)
    log = [(f"r{0 if rng.random() < .6 else rng.randrange(5)}", i, f"n{rng.randrange(3)}",
            rng.choice(["enter", "exit"]), "ok", i * 10, 0, 0, 0) for i in range(1500)]
    df = spark.createDataFrame(log, "run_id string, seq bigint, node string, phase string, outcome "
                               "string, duration_ms bigint, model_calls bigint, input_tokens bigint, "
                               "output_tokens bigint")
    got = {(r["run_id"], r["node"], r["enter_seq"], r["exit_seq"]) for r in pair_nodes(df).collect()}
    open_, want = {}, set()
    for run, seq, node, phase, *_ in log:
        stack = open_.setdefault((run, node), [])
        if phase == "enter":
            stack.append(seq)
        else:
            want.add((run, node, stack.pop() if stack else None, seq))
    for (run, node), stack in open_.items():
        want |= {(run, node, seq, None) for seq in stack}
    assert got == want
