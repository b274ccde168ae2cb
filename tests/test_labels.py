"""Label queries over every customer."""

from staycheck import catalog
from staycheck.operators import labels
from staycheck.plans.adapters import TWO_KIND_LABELS, customer_labels

SF = "/root/testdata/sf0.001"


def test_every_customer_is_looked_up_by_kind(spark):
    got = {r.custkey: r for r in catalog.load()[0]["jn_01_kinds"](spark, SF).collect()}
    own = {r.custkey: r.label for r in customer_labels(spark, SF).collect()}
    assert set(got) == set(own)
    assert all(r.label == (TWO_KIND_LABELS[k % 35] if k % 35 < 7 else own[k]) for k, r in got.items())
    said = {r.label: (r.country, r.rate) for r in got.values()}
    assert said["HU"] == said["hu "] == ("HU", "HOUSE") and said["Block"][0] is None and said["nowhere"] == (None, None)
    assert any(r.country and r.custkey % 7 for r in got.values() if r.label not in TWO_KIND_LABELS)


def test_left_out_and_moved_words_are_offered(spark):
    rows = [("country", "ZA", "South Africa"), ("country", "SA", "Saudi Arabia"), ("country", "KR", "Korea, Republic of"),
            ("country", "FI", "Finland")]
    index = labels.alias_index(spark.createDataFrame(rows, "kind string, code string, label string"))
    asked = spark.createDataFrame([("Africa",), ("Arabia",), ("Republic of Korea",), ("zzz",)], "label string")
    found = labels.candidates(asked, "label", index)
    best = {r.label: (r.code, round(r.score, 3)) for r in found.filter("rank = 1").collect()}
    assert best == {"Africa": ("ZA", 0.667), "Arabia": ("SA", 0.667), "Republic of Korea": ("KR", 0.647)}
