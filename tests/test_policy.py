"""Policy documents: the committed one, another one, and everything that is refused."""

import copy
import json

import pytest

from staycheck import values
from staycheck.plans.adapters import other_policy
from staycheck.sources.policy import PolicyError, committed_document, parse_policy, read_policy
from staycheck.sources.rulesets import rulesets

BAND = "tolerances.by_metric_type.percentage_points"


def changed(path, value=None, *, gone=False, document=None):
    out = copy.deepcopy(document or committed_document())
    node, parts = out, path.split(".")
    for part in parts[:-1]:
        node = node[int(part) if part.isdigit() else part]
    last = int(parts[-1]) if parts[-1].isdigit() else parts[-1]
    if gone:
        del node[last]
    else:
        node[last] = value
    return out


def override(value, row=0):
    return changed(f"permutations.ordered.{row}.override", value)


INVALID = [
    (["a list"], "a policy is a mapping, not list"),
    (changed("schema_version", 2), "schema_version is 2, not 1"),
    (changed("version", gone=True), "version is missing"),
    (changed("metrics.occupancy_pct.denominator", "beds"), "metrics.occupancy_pct.denominator is 'beds', not one of"),
    (changed("metrics.occupancy_pct.denominator", gone=True), "metrics.occupancy_pct.denominator is missing"),
    (changed("metrics.occupancy_pct.exclude_out_of_order", "yes"), "exclude_out_of_order is 'yes', not a bool"),
    (changed("metrics.guests_by_nationality.counts", "rooms"), "counts is 'rooms', not one of"),
    (changed("qualifying.status.excluded", ["CANCELLED"]), "qualifying.status rules on NO_SHOW neither way"),
    (changed("qualifying.status.excluded", ["CANCELLED", "NO_SHOW", "IN_HOUSE"]), "both includes and excludes IN_HOUSE"),
    (changed("qualifying.status.included", ["CHECKED_OUT", "IN_HOUSE", "SLEEPING"]), "qualifying.status names SLEEPING"),
    (changed("qualifying.rate_code.included", ["BAR", "BAR", "CORP", "GOV", "OTA", "GROUP", "COMP"]), "repeats a member"),
    (changed("qualifying.rate_code.excluded", "HOUSE"), "qualifying.rate_code.excluded is not a list of names"),
    (changed("qualifying.rate_code.excluded", gone=True), "qualifying.rate_code.excluded is missing"),
    (changed(f"{BAND}.type", "relative"), "percentage_points is not absolute"),
    (changed(f"{BAND}.value", "wide"), "is no number from 0 up"),
    (changed(f"{BAND}.value", -0.1), "is no number from 0 up"),
    (changed("tolerances.by_metric_type.count.type", "absolute"), "tolerances.by_metric_type.count is not exact"),
    (changed("classification.order", ["V2", "V7", "V5", "V1", "V6"]), "classification.order is"),
    (changed("classification.classes.V1", gone=True), "classification.classes.V1 lacks a name"),
    (changed("classification.classes.V2.escalates_to", "somebody"), "V2 escalates to 'somebody'"),
    (changed("materiality.severity_by_class.V5", "dire"), "severity_by_class.V5 is not one of"),
    (changed("materiality.severity_by_class.V7", "material"), "severity_by_class.V7 is not blocking"),
    (changed("permutations.ordered", gone=True), "permutations.ordered is no list"),
    (changed("permutations.ordered.0.id", gone=True), "alternative 1 has no id"),
    (changed("permutations.ordered.1.id", "P-OCC-DENOM-ROOMS"), "P-OCC-DENOM-ROOMS: id repeats"),
    (changed("permutations.ordered.0.id", "BASELINE"), "BASELINE: id repeats"),
    (changed("permutations.ordered.0.applies_to", ["revenue"]), "applies_to is not a list of metrics in scope"),
    (override({}), "P-OCC-DENOM-ROOMS: changes nothing"),
    (override({"metrics.occupancy_pct.denominatorr": "rooms_available"}), "metrics.occupancy_pct.denominatorr does not exist"),
    (override({"metrics.occupancy_pct.denominator": "beds"}), "P-OCC-DENOM-ROOMS: metrics.occupancy_pct.denominator is 'beds'"),
    (override({"metrics.occupancy_pct.denominator": "room_nights_available"}), "P-OCC-DENOM-ROOMS: equals the baseline"),
    (override({"qualifying.status.included": ["CHECKED_OUT"]}), "P-OCC-DENOM-ROOMS: qualifying.status rules on IN_HOUSE neither way"),
    (override({"qualifying.rate_code.included": list(values.RATE_CODES)}), "qualifying.rate_code both includes and excludes HOUSE"),
]


@pytest.mark.parametrize("document, reason", INVALID, ids=range(len(INVALID)))
def test_an_invalid_policy_is_refused_with_its_reason(document, reason):
    with pytest.raises(PolicyError) as refused:
        parse_policy(document)
    assert any(reason in p for p in refused.value.problems), refused.value.problems


def test_every_problem_is_named_at_once():
    document = changed("version", gone=True, document=changed("schema_version", 3, document=changed(f"{BAND}.value", None)))
    with pytest.raises(PolicyError) as refused:
        parse_policy(document)
    assert len(refused.value.problems) == 3


def test_the_committed_document_is_the_committed_rules(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps(committed_document()))
    policy = read_policy(spark, str(tmp_path / "policy.json"))
    assert list(policy.rules) == rulesets() and policy.version == values.POLICY_VERSION
    assert float(policy.percentage_tolerance) == float(values.PERCENTAGE_TOLERANCE)
    assert list(policy.class_rules) == values.CLASS_RULES
    (tmp_path / "broken.json").write_text("{a: [")
    with pytest.raises(PolicyError):
        read_policy(spark, str(tmp_path / "broken.json"))


def test_another_policy_starts_from_its_own_baseline():
    rules = {r.ruleset_id: r for r in other_policy().rules}
    assert "P-COMP-EXCLUDED" not in rules and rules["BASELINE"].rate_in == ("BAR", "CORP", "GOV", "OTA", "GROUP")
    assert rules["P-CHILDREN-EXCLUDED"].rate_in == rules["BASELINE"].rate_in  # alternatives change the baseline of their own policy
