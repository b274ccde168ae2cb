import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from staycheck.llm import substring_dedup as sd


def brute(rows, window):
    """rows of (doc_id, text), ids distinct -> {doc_id: (n_words, n_removed, kept text)}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("window", [3, 20])
def test_against_brute_force(spark, window):
    rng = np.random.default_rng(5)
    passages = [" ".join(rng.choice(list("abcdefghijkl"), 30)) for _ in range(4)]
    rows = [(7, None), (3, ""), (-2, "a b c"), (90, "x " * 50), (91, "x\t" * 49 + "\ny"), (12, "Ünï cöde " * 30)]
    for i in range(100, 160):
        rows.append((i, "  ".join([" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 60))),
                                   passages[i % 4], " ".join(rng.choice(list("mnop"), 5))])))
    rows.append((500, rows[-1][1]))
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, row_key string").repartition(5)
    got = {r.doc_id: (r.n_words, sum(s["last"] - s["first"] for s in r.removed), r.kept_text)
           for r in sd.substring_dedup(df, window, bucket_windows=100, group_bytes=2000).collect()}
    assert got == brute(rows, window)


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (1, "z " + text), (None, text), (None, None), (5, text + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_words - len(r.kept_text.split())) for r in sd.substring_dedup(df).collect())
    assert [g for g in got if g[0] != "1"] == [("5", 31, 30), ("None", 0, 0), ("None", 30, 0)]
    assert sorted(g[1:] for g in got if g[0] == "1") == [(30, 30), (30, 30), (31, 30)]
    assert sd.substring_dedup(df.limit(0)).count() == 0


def test_long_text_and_packing(spark):
    words = [hashlib.md5(bytes([i % 251, i // 251 % 251])).hexdigest()[:6] for i in range(30000)]
    text = " ".join(words + words[:40])
    got = sd.substring_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, len(got.removed), got.removed[-1]["last"]) == (30040, 1, 30040)
    arrays = [np.array([5, -3, 1 << 40]), np.array([], np.uint16), np.array([7], np.uint32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, sd.unpack(sd.pack(*arrays))))


def test_a_passage_in_a_third_of_all_documents_costs_its_bucket_one_entry():
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"own{i} " * 5 + passage if i % 3 == 0 else " ".join(f"w{i}x{k}" for k in range(45)) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(range(900), pa.int64()), pa.array(texts)],
                                       ["doc_id", "row_key", "text"])
    by_bucket, by_group = Counter(), Counter()
    for out in sd._hash_windows(20, 8, 16)(iter([batch])):
        for bucket, docs in zip(out.column("bucket").to_pylist(), out.column("docs").to_pylist()):
            if bucket >= 0:
                by_bucket[bucket] += len(sd._spread(docs)[0])
            else:
                by_group[bucket] += len(sd.unpack(docs)[0])
    whole = sum(max(0, len(t.split()) - 19) for t in texts)
    assert sum(by_bucket.values()) + sum(by_group.values()) == whole and sum(by_group.values()) == 299 * 21
    assert max(by_bucket.values()) < 3 * sum(by_bucket.values()) / len(by_bucket)
    assert max(by_group.values()) < 3 * sum(by_group.values()) / len(by_group)
