import hashlib
import random
import re

from staycheck.llm import fingerprint as fp
from staycheck.llm.common import doc_rows

SCHEMA = "doc_id long, text string, tree string, next int, place string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text: str):
    sections = [[[m.group() for m in re.finditer(fp.PIECE, p)] for p in re.findall(fp.PARAGRAPH, s.group())]
                for s in re.finditer(fp.SECTION.replace(r"\z", r"\Z"), text)]
    assert "".join(x for s in sections for p in s for x in p) == text  # nothing is lost
    root = sha("".join(sha("".join(sha("".join(map(sha, p))) for p in s)) for s in sections))
    return root, {root[:15], *(sha(x)[:15] for s in sections for p in s for x in p)}


def prose(rng, words):
    out = []
    for _ in range(words):
        out.append("".join(rng.choice("abdehrst") for _ in range(rng.randint(1, 9))))
        if rng.random() < 0.1:
            out.append(rng.choice([".\n", ".\n\n", "\n# ", "é𝄞", "\t"]))
    return " ".join(out)


def texts():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([3, 40, 400]))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "x" * 1000), (53, "\n\n\n"), (54, "ab"), (55, rows[0][1]), (60, "long words here " * 60_000),
                   (7, "another text with a known id"), (None, "no id"), (None, "no id either")]


def test_trees_and_likeness_equal_a_plain_form(spark):
    rows = [(i, t, "x", 1, "y") for i, t in texts()]
    got = fp.with_tree(doc_rows(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by_text = {t or "": plain_tree(t or "") for _, t in texts()}
    for r in got:
        root, nodes = by_text[r["text"]]
        assert r["root"] == root
        assert sorted(r["nodes"]) == sorted(int(n, 16) for n in nodes)


def test_next_document_across_ranges(spark):
    rows = [(i, t, "x", 1, "y") for i, t in texts()]
    rows.append(rows[3])
    for range_bytes in (1 << 30, 3000, 100):
        df = doc_rows(spark.createDataFrame(rows, SCHEMA)).where("length(text) < 100000")
        got = fp.with_next(df, ["text"], range_bytes=range_bytes).collect()
        order = sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["row_key"]), reverse=True)
        assert len(order) == len(rows) - 1
        assert [r["next_text"] for r in order] == [r["text"] for r in order[1:] + order[:1]]
    assert fp.with_next(doc_rows(spark.createDataFrame([], SCHEMA)), ["text"]).collect() == []
    alone = fp.with_next(doc_rows(spark.createDataFrame(rows[:1], SCHEMA)), ["text"]).first()
    assert alone["next_text"] == alone["text"]


def test_an_edit_is_located(spark):
    lines = [f"line {n} of the part says something of its own, at some length, for the reader" for n in range(30)]
    text = "\n".join(lines[:10]) + "\n\n" + "\n".join(lines[10:])
    edited = text.replace("line 17 of the part", "line 17 of this changed part")
    trees = [fp.fingerprints(spark.createDataFrame([(1, t), (2, "same"), (None, "no id")], "doc_id long, text string"))
             for t in (text, edited)]
    got = fp.differences(*trees).collect()
    assert got and {(r["doc_id"], r["section"], r["paragraph"]) for r in got} == {(1, 1, 7)}
    assert {r["side"] for r in got} == {"before", "after"}
    gone = fp.differences(trees[0], trees[1].where("doc_id = 1")).where("doc_id is null or doc_id = 2").collect()
    assert [(r["side"], r["section"], r["paragraph"], r["piece"]) for r in gone] == [("before", 0, 0, 0)] * 2
