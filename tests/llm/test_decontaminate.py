import random

from staycheck.llm import decontaminate as dc
from staycheck.llm.queries import op7_decontaminate

SF = "/root/testdata/sf0.001"


def distance_in(text, item):
    """Least edit distance of item to any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def brute(docs, items, rate=dc.RATE, piece=dc.PIECE):
    out = {}
    for i, text in docs:
        s = dc.normalised(text or "")
        for n, item in items:
            p = dc.normalised(item or "")
            if not p:
                continue
            k = max(0, min(int(len(p) * rate), len(p) // piece - 1))
            d = distance_in(s, p) if len(p) >= piece else (0 if f" {p} " in f" {s} " else 1)
            if d <= k:
                out[i, n] = d
    return out


def planted(rng):
    words = lambda n: [rng.choice(["the", "onen", "ther", "edin", "ing", "thor", "Éa", "re,"]) + rng.choice("abcdef") for _ in range(n)]
    items = [(n, " ".join(words(rng.randint(8, 50)))) for n in range(12)] + [(20, "theb"), (21, ""), (22, None), (23, "...")]
    docs = [(1, None), (2, ""), (3, " ".join(words(40)))]
    for i in range(60):
        item = list(items[i % 12][1])
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(item))
            item[at:at + rng.randint(0, 1)] = rng.choice(["", "z", "qq"])
        text = "".join(item).upper() if i % 3 == 0 else "".join(item).replace(" ", "!! \n")
        docs.append((10 + i, " ".join(words(rng.randint(0, 20))) + " " + text + " " + " ".join(words(rng.randint(0, 9)))))
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted(random.Random(8))
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(n, t, 0) for n, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for block in (dc.BLOCK_BYTES, 300):
        got = {(r.doc_id, r.item_id): r.distance for r in dc.find_items(d, b, block_bytes=block).collect()}
        assert got == want
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert dc.find_items(d.limit(0), b).count() == 0 == dc.find_items(d, b.limit(0)).count()
    assert dc.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_query_finds_whole_items(spark):
    docs = [(r.doc_id, dc.normalised(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, dc.normalised(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {(i, n) for i, t in docs for n, s in items if s in t}
    got = {(r.doc_id, r.item_id): r.distance for r in op7_decontaminate(spark, SF).collect()}
    assert exact and exact == {k for k, d in got.items() if d == 0}
