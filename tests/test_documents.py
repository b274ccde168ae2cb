"""Versions of documents: what is sent, and what is told of deep, wide and repeated ones."""

import collections
import json

from staycheck.operators import documents


def frames(spark, *sides):
    return [spark.createDataFrame(rows, "id int, d string") for rows in sides]


def told(spark, first, second, volatile=()):
    found = documents.diff_documents(*frames(spark, first, second), "id", "d", list(volatile))
    return collections.Counter(tuple(r) for r in found.collect())


def test_members_meet_inside_their_row(spark, monkeypatch):
    """Versions are joined by key, once; no member is sent, and a deep document is not written at each level."""
    plans, stage = [], documents.stage

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    monkeypatch.setattr(documents, "stage", watched)
    wide = {f"f{i}": i for i in range(100)}
    deep = '{"d": ' * 20 + "%d" + "}" * 20
    found = told(spark, [(1, json.dumps({"w": wide})), (2, deep % 1)], [(1, json.dumps({"w": {**wide, "f7": "7"}})), (2, deep % 2)])
    assert found == {(1, "w.f7", "value"): 1, (2, ".".join("d" * 20), "value"): 1}
    assert sum("Join " in p for p in plans) == 1
    # before a plain explode the members would be worked out once more to see whether there are any
    assert max(p.count("map_zip_with") for p in plans) == documents.LEVELS_A_PASS
    assert len(plans) < 10


def test_levels_lists_and_names(spark):
    first = '{"a.b": {"c": 1}, "a": {"b.c": 1, "t": 1}, "": {"x": [1, {"y": null}]}, "l": [[1, 2], [3]], "e": [], "n": 1e2}'
    second = '{"n": 100, "a": {"b.c": 2, "t": 2}, "a.b": {"c": 2}, "": {"x": [1, {}]}, "l": [[1, "2"], [3, 4]], "e": {}}'
    assert told(spark, [(1, first)], [(1, second)], ["a.t"]) == {
        (1, "a.b.c", "value"): 2, (1, "x[1].y", "one side only"): 1, (1, "l[0][1]", "value"): 1,
        (1, "l[1]", "length"): 1, (1, "e", "other kind"): 1}


def test_versions_of_a_repeated_key_all_meet(spark):
    first = [(1, '{"a": 1}'), (1, '{"a": 2}'), (None, '{"a": 1}'), (2, "{"), (3, None), (4, "{}")]
    second = [(1, '{"a": 1}'), (1, '{"a": 3}'), (None, '{"a": "1"}'), (2, "{}"), (3, None), (5, "{}")]
    found = told(spark, first, second)
    assert {k for k in found if k[0] == 1} == {(1, "a", "value")}
    assert {k: n for k, n in found.items() if k[0] != 1} == {
        (None, "a", "value"): 1, (2, "", "unreadable"): 1, (4, "", "one side only"): 1, (5, "", "one side only"): 1}
