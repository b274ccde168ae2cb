import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest

from staycheck.llm import periodic
from staycheck.llm.queries import op13_periodic_runs


def plain_runs(w, shortest=24, repeats=3):
    """Every period, every maximal stretch of it, and no smaller period over the whole stretch."""
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, repeats * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def patterned(rng, n, kinds):
    w = []
    while len(w) < n:
        if rng.random() < 0.5:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 10))] * rng.randint(1, 8)
    return w


def test_runs_equal_the_plain_form():
    rng = random.Random(4)
    for _ in range(1500):
        w, shortest = patterned(rng, rng.randint(0, 140), rng.choice([1, 2, 2, 3, 5])), rng.choice([3, 6, 24])
        assert periodic.runs(w, shortest) == plain_runs(w, shortest)


def test_work_stays_near_linear():
    small, large = [1, 2, 1], [1, 2, 1]
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a  # many nested repeats
    for words in ([1] * 100_000, list(range(500)) * 200, b):
        begun = time.time()
        assert periodic.runs(words)
        assert time.time() - begun < 30
    assert periodic.runs(small) == periodic.runs(large) == []


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in patterned(rng, rng.randint(0, 300), rng.choice([1, 2, 4, 400]))) for _ in range(120)]
    out = list(enumerate(texts))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "é " * 40), (204, "a b\x1c" * 30), (None, "x " * 30), (None, None)]
    return out + [out[3], out[3], (5, "y z " * 20), (300, "\t\x0b".join(["a", "b", "\n", "c"] * 30))]


def test_the_query_equals_the_plain_form(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, runs string, words string, a int") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 20


def test_empty_table_and_other_thresholds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty).collect() == []
    df = spark.createDataFrame([(1, "a b a b a b a b"), (2, "a b a b a b a c")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.find_runs(df, shortest=8).collect()}
    assert got == {1: [(0, 8, 2)], 2: []}
    with pytest.raises(ValueError):
        periodic.find_runs(df, repeats=2)
