import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from staycheck.llm import simhash
from staycheck.llm.queries import op6_simhash
from staycheck.session import stage

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """(id, print) -> smallest id reachable, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(prints)}


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, SF).collect()}
    want = brute_components(docs)
    assert got == {d: (f"{p:016x}", want[d]) for d, p in docs}


def test_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \t\n", "x"), (4, "one", "x"), (2, "ONE", "y"), (7, "one two", "z"),
            (8, "É a b c", None), (None, "alone here now", "x"), (4, "one", "x"), (11, "w " * 70000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(df).collect()), key=str)
    texts = {(i, t) for i, t, _ in rows}
    assert len(got) == len(rows) and {(i, f"{brute_print(t):016x}") for i, t in texts} == {g[:2] for g in got}
    by = {g[0]: g[2] for g in got}
    assert by[3] == by[5] == by[9] and by[4] == by[2] == 2 and by[None] is None
    assert simhash.near_dedup(df.limit(0)).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()).count("2") == 1


@pytest.mark.parametrize("crowd", [2, 256])
def test_links_of_crowded_signatures(spark, crowd):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)}
    values |= {base[0] ^ 1 << k for k in range(64)} | {base[1] ^ (1 << k | 1 << k + 1) for k in range(32)}
    prints = list(enumerate(sorted(values)))
    signed = [v - (1 << 64) if v >> 63 else v for _, v in prints]
    nodes = spark.createDataFrame([(v,) for v in signed], "print long")
    edges = simhash.links(nodes, crowd)
    assert edges.where(F.expr("bit_count(a ^ b) > 2")).count() == 0
    from staycheck.llm.graph import components
    root = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for (i, _), s in zip(prints, signed):
        groups.setdefault(root.get(s, s), set()).add(i)
    want = {}
    for i, least in brute_components(prints).items():
        want.setdefault(least, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_shared_signatures_are_merged_at_every_size(spark, monkeypatch):
    """A broadcast of the smaller corpus's signatures hid a shuffle that the larger one needs."""
    plans = []

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(simhash, "persisted", recorded)
    prints = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,)], "print long")
    simhash.links(prints)
    joins = [p for p in plans if "Join" in p]
    assert joins and all("SortMergeJoin [signature" in p and "BroadcastHashJoin" not in p for p in joins)
