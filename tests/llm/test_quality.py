import zlib

import numpy as np
from pyspark.sql import functions as F

from staycheck.llm import quality as q
from staycheck.llm.queries import op8_quality

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op8_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    score, named, y = map(np.array, zip(*held))
    assert auc(score, y) > 0.97 and (named == y).mean() > 0.97


def test_tables_add_up_and_pairs_matter():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(q.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = q.train(x, y)
    assert auc(model.score(x), y) > 0.9
    b = model.bins(x[:50])
    total = [model.base + sum(t[b[i, f]] for f, t in enumerate(model.tables))
             + sum(t[q.coarse(b[i, f]), q.coarse(b[i, g])] for f, g, t in model.pairs) for i in range(50)]
    assert np.allclose(model.score(x[:50]), 1 / (1 + np.exp(-np.array(total))))


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "a b", None), (3, "word " * 200000, 0.1), (3, "word", 0.1), (3, "word", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (9, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 2")):
        got = q.score(df, q.fit(df, known, F.lit(True))).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert q.score(df.limit(0), q.fit(df, labels, F.lit(True))).count() == 0
