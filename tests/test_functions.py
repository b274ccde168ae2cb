"""Scalar rules on literal rows."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from staycheck.functions import cells, keys, periods, text
from staycheck.operators import documents, labels


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalise_key(spark):
    got = column(spark, ["CZECH  REPUBLIC", "Czech Rep.", "U.S.A.", " Hong-Kong ", "Côte d'Ivoire"],
                 text.normalise_key)
    assert got == ["czech republic", "czech rep", "usa", "hongkong", "cte divoire"]


@pytest.mark.parametrize("raw, wanted", [
    ("January 2026", "2026-01"), ("2026-Q1 total", "2026-Q1"), ("2026-03", "2026-03"),
    ("2026", "2026"), ("2026 Sept", "2026-09"), ("q1 2026", None), ("2026-13", None),
    ("Total", None), ("2026 Q3", "2026-Q3"), ("YTD 2026-q2", "2026-Q2"),
])
def test_period_label(spark, raw, wanted):
    assert column(spark, [raw], periods.parse_period_label) == [wanted]


@pytest.mark.parametrize("raw, value, problem", [
    ("81.70%", "81.7000000000", None), ("1,285", "1285.0000000000", None),
    ("(44)", "-44.0000000000", None), ("AED 612.40", "612.4000000000", None),
    ("=SUM(B2:B4)", None, "uncached formula"), ("n/a", None, "not a figure"), ("", None, None),
    ("0.12345678901", None, "too many decimals"), ("Q1,2026", None, "not a figure"),
    ("$1,285 ", "1285.0000000000", None),
])
def test_cell_text(spark, raw, value, problem):
    df = spark.createDataFrame([(raw,)], "t string").select(cells.cell_value(
        F.col("t"), F.lit(None).cast("decimal(38,10)"), F.lit("General"), F.lit("text")).alias("v"))
    row = df.first()["v"]
    assert (str(row["value"]) if row["value"] is not None else None, row["problem"]) == (value, problem)


def test_stored_fraction_is_scaled(spark):
    df = spark.range(1).select(cells.cell_value(
        F.lit(None).cast("string"), F.lit("0.6909").cast("decimal(38,10)"), F.lit("0.00%"),
        F.lit("number")).alias("v"))
    assert str(df.first()["v"]["value"]) == "69.0900000000"


def test_looks_numeric(spark):
    got = column(spark, ["2026", "1,285", "AED 612.40", "81.70%", "(44)", "January", "$", "",
                         "Q1,2026", "12 percent"], cells.looks_numeric)
    assert got == [True, True, True, True, True, False, False, False, False, True]


def test_a1_references(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 18278]
    letters = column(spark, numbers, cells.column_letters, "int")
    assert letters == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]
    assert column(spark, letters, cells.column_number) == numbers
    assert column(spark, ["D14", "b5:e25", "$B$5", "E5:B2", "B:E"],
                  lambda c: cells.render_rect(cells.parse_rect(c))) == [
        "D14", "B5:E25", None, None, None]


def test_redaction_is_sequential(spark):
    raw = "+971.50.123.4567@hotel.ae"
    df = spark.createDataFrame([(raw,)], "t string")
    counts = text.redaction_counts(F.col("t"))
    row = df.select(*[c.alias(n) for n, c in counts.items()]).first()
    assert row["email"] == 1 and row["phone"] == 0
    got = column(spark, ["Dr. Jane Marie Doe left", "DOE/JANE", "call +971 50 123 4567 now", "Q1/Q2"],
                 text.redact)
    assert got == ["[redacted:titled_name] left", "[redacted:slashed_name]",
                   "call [redacted:phone] now", "Q1/Q2"]


def test_transpose(spark):
    assert column(spark, [83, 8, 44, 120], text.transpose_digits, "bigint") == [38, None, None, 210]


def test_tolerance(spark):
    rows = [("occupancy_pct", "0.05"), ("occupancy_pct", "-0.10"), ("occupancy_pct", "0.11"),
            ("room_nights_sold", "1"), ("room_nights_sold", "0")]
    df = spark.createDataFrame(rows, "m string, d string").select(keys.within_tolerance(
        F.col("d").cast("decimal(38,10)"), F.col("m")))
    assert [r[0] for r in df.collect()] == [True, True, False, False, True]


def test_output_shapes(spark):
    docs = {None: "nothing", "{}": "an empty object", "[1,2]": "[2]", "[]": "[0]", "3": "3", "1.0": "1.0", '"x"': '"x"', "true": "yes",
            "null": "-", "{bad": "unreadable JSON (4 chars)", '{"a":1,"a":2}': "a 2", '{"a\\"b":1.0,"c":null}': 'a"b 1.0 · c -',
            '{"l":[1,2],"o":{"x":[1]},"t":"%s","f":false}' % ("y" * 49): "l [2] · o {1} · t …(49 chars) · f no",
            '{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6,"g":7}': "a 1 · b 2 · c 3 · d 4 · e 5 · f 6 · +1 more field(s)"}
    assert column(spark, list(docs), documents.shape) == list(docs.values())
    assert column(spark, ['{"a":"xyz","b":1}'], lambda c: documents.shape(c, 1, 2)) == ["a …(3 chars) · +1 more field(s)"]


def test_month_names(spark):
    names = ["pms_2026-02.pdf", "export 2026-99 2026-03.pdf", "claims_2026-Q1.xlsx", "x.pdf"]
    assert column(spark, names, text.month_in_name) == ["2026-02", "2026-03", None, None]
    assert column(spark, names, text.month_of_report) == ["2026-02", None, "2026-Q1", None]


def test_candidates_match_brute_force(spark):
    """Shortlist against every alias, one by one."""
    rng = random.Random(5)
    words = [label for _, _, label in labels.country_labels()]
    raw = {w[:i] + w[i + 1:] for w in rng.sample(words, 60) for i in [rng.randrange(len(w))]}
    raw |= {" ".join(rng.sample(w.split(), len(w.split()) - rng.randrange(2))) for w in words if " " in w}
    raw = sorted(raw | {"Austrlia", "zzz", "", "!", "aaaaaaaa", "pain", "arab republic egypt", "a" * 300})
    df = spark.createDataFrame([(r,) for r in raw], "label string")
    index = labels.alias_index(labels.committed_labels(spark)).filter("kind = 'country'")
    shortlist = labels.candidates(df, "label", index)
    got = {}
    for r in shortlist.orderBy("label", "rank").collect():
        got.setdefault(r["label"], []).append((r["code"], r["alias"], r["score"], r["left_out"]))
    aliases = [(r["alias_key"], r["code"]) for r in index.collect()]
    keys = {r["label"]: r["key"] for r in df.select("label", text.normalise_key(F.col("label")).alias("key")).collect()}
    for label, key in keys.items():
        best = {}
        for alias, code in aliases:
            score = difflib.SequenceMatcher(None, key, alias).ratio()
            if key and score >= 0.6:
                best[code] = min(best.get(code, (1.0, "")), (-score, alias))
        want = sorted((*v, code) for code, v in best.items())
        assert got.get(label, []) == [(c, a, -s, max(0, len(want) - 5)) for s, a, c in want[:5]]
    one, two = "abcd", "abce"  # two codes equally close
    near = spark.createDataFrame([("country", "X1", one), ("country", "X2", two)], "kind string, code string, alias_key string")
    asked = spark.createDataFrame([("abcx",), ("abcd",)], "label string")
    assert [r["label"] for r in labels.ambiguous(labels.candidates(asked, "label", near)).collect()] == ["abcx"]


def test_labels_of_two_kinds_never_multiply(spark):
    index = labels.alias_index(labels.committed_labels(spark))
    df = spark.createDataFrame([("HU",), ("CO",), ("Block",)], "label string")
    assert labels.normalise_labels(df, "label", index, "code").count() == 3
    found = labels.normalise_labels(df, "label", index, "code", "country").collect()
    assert {r["label"]: r["code"] for r in found} == {"HU": "HU", "CO": "CO", "Block": None}
