import math

import numpy as np
import pytest

from staycheck.llm import whitening
from staycheck.llm.queries import op12_whitening


def spd(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41), 10.0 ** -np.arange(0, 8), [5, 5, 5, 2, 2, 1e-3], [1.0], [3, 3 + 1e-9, 3 + 2e-9, 1, 0, 0],
    [0, 0, 0], np.ones(12), [1e12, 1, 1e-1]])
def test_leading_pairs(values):
    a = spd(np.array(values, float))
    a = (a + a.T) / 2
    want = np.sort(values)[::-1]
    found = whitening.Slicer(a).leading(32)
    scale = max(map(abs, values))
    assert len(found) == min(32, sum(v > 1e-15 * scale for v in want) if scale else 0)
    assert np.allclose([e for e, _ in found], want[:len(found)], rtol=0, atol=1e-12 * scale)
    if found:
        q = np.stack([v for _, v in found], axis=1)
        assert np.abs(q.T @ q - np.eye(len(found))).max() < 1e-13
        assert np.abs(a @ q - q * [e for e, _ in found]).max() < 1e-12 * scale


def test_counts():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 10, 40):
        for _ in range(20):
            a = rng.integers(-3, 4, (d, d)).astype(float)
            a = a + a.T - 0.5 * np.eye(d)
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.inertia(a) == (e > 0).sum()
    assert whitening.inertia(np.zeros((4, 4))) == 0


def test_the_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = (rng.standard_normal((400, 40)) * np.geomspace(9, 0.2, 40) + 3).astype("float32")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0, 2.0], 1), (903, [math.nan] * 40, 1), (904, [math.inf] + [0.0] * 39, 1),
           (905, [None] + [0.0] * 39, 1)]
    good = rows + [(None, [1.0] * 40, 2), rows[0], rows[0]]
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, x int").repartition(5) \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path)).collect()
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in good])
    n, sums = len(x), x.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    z = (x - sums / n) @ (q / np.sqrt(e))
    assert len(got) == n * 32
    z = z * np.sign(q[np.abs(q).argmax(axis=0), np.arange(40)])
    by_id = {i: row for (i, _, _), row in zip(good, zip(z, ((n * x - sums) ** 2).sum(axis=1).tolist()))}
    assert got[0]["identity_error"] < 1e-9
    for r in got:
        row, deviation = by_id[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] - row[r["component"] - 1]) < 1e-8
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12


def test_what_has_no_component(spark):
    schema = "vec_id long, x array<long>"
    for rows in ([], [(1, [4, 5])], [(1, [4, 5]), (2, [4, 5])], [(1, None), (2, [])]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = spark.createDataFrame([(1, [4, 5]), (2, [4, 7]), (3, [1 << 60])], schema)
    got = whitening.whiten(df, whitening.fit(df)).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"]) for r in got] == [(1, 1, 2, 4, -1.0), (2, 1, 2, 4, 1.0)]


def test_large_entries_are_exact(spark):
    rows = [(i, [i * (1 << 40), -i, 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(4)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.fit(df)).collect()}
    s = [sum(x[j] for _, x in rows) for j in range(3)]
    exact = {i: sum((50 * x[j] - s[j]) ** 2 for j in range(3)) for i, x in rows}
    assert got == {i: v if v < 1 << 63 else None for i, v in exact.items()}
