import hashlib
import random

import pytest

from staycheck.llm import exact_dedup as ed


def lowered(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for i, text in rows:
        ids = [x for x in groups[lowered(text)] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[lowered(text)]), i == keep, hashlib.sha256(lowered(text)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,bits", [(8192, 64), (7, 64), (5, 3), (64, 8)])
def test_against_brute_force(spark, block, bits):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcÉé \n") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    rows = [(n, rng.choice([str.upper, str, str.lower])(rng.choice(base))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, None), (None, base[0]), (None, "alone"), (3, base[1]), (3, base[1]), (3, "x" * 50),
             (7, "ab" * 40), (8, "ab" * 40 + "a"), (9, "AB" * 40), (9, "AB" * 40)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, kept string").repartition(4)
    out = ed.exact_dedup(df, block, bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out), key=str) == brute(rows)


def test_drop_and_empty(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "y"), (2, "a B", "y"), (5, None, None)], "doc_id long, text string, name string")
    kept = ed.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.name) for r in kept.collect()) == [(2, "y"), (5, None)]
    assert ed.exact_dedup(df.limit(0)).count() == 0 == ed.drop_exact_copies(df.limit(0)).count()
