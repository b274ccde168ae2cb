"""Policy documents: the rules a verification runs under, read, checked and turned into rulesets.

A document is nested. What is declared in SETTINGS must be there, of its type and within what is allowed;
other entries are left alone. Alternatives change settings by their dotted path, and each of them must leave
every partition disjoint and total. A document with any problem is refused with all of them.
"""

import json
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation

from pyspark.sql import SparkSession

from staycheck import values
from staycheck.sources.rulesets import Ruleset


class PolicyError(ValueError):
    """problems: one line for each thing a document gets wrong."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


# fixed values: where a document keeps each setting of a ruleset, and what it may be
BASES = ("occupied_night", "arrival_month", "departure_month")
SETTINGS = {
    "qualifying.day_use.counts_room_nights": ("day_use_counts_room_nights", bool, None),
    "qualifying.day_use.counts_guests": ("day_use_counts_guests", bool, None),
    "metrics.occupancy_pct.denominator": ("denominator", str, ("room_nights_available", "rooms_available")),
    "metrics.occupancy_pct.month_basis": ("occ_month_basis", str, BASES),
    "metrics.occupancy_pct.exclude_out_of_order": ("exclude_out_of_order", bool, None),
    "metrics.guests_by_nationality.counts": ("counts", str, ("guests", "arrivals", "room_nights")),
    "metrics.guests_by_nationality.include_children": ("include_children", bool, None),
    "metrics.guests_by_nationality.month_basis": ("nat_month_basis", str, BASES),
}
PARTITIONS = {
    "qualifying.status": ("status_in", values.STATUSES),
    "qualifying.rate_code": ("rate_in", values.RATE_CODES),
}
SEVERITIES = ("blocking", "material", "informational")
TARGETS = ("human_review", "policy_owner", "hotel", "none")
LADDER = [row[0] for row in values.CLASS_RULES]


@dataclass(frozen=True)
class Policy:
    """rules: baseline first, then the alternatives in order. class_rules: rows like values.CLASS_RULES."""
    version: str
    rules: tuple[Ruleset, ...]
    percentage_tolerance: str
    class_rules: tuple[tuple, ...]


DEFAULT_TOLERANCE = values.PERCENTAGE_TOLERANCE
_ABSENT = object()


def at(document, path: str):
    for part in path.split("."):
        if not isinstance(document, dict) or part not in document:
            return _ABSENT
        document = document[part]
    return document


def _setting_problem(path: str, value) -> str | None:
    _, kind, allowed = SETTINGS[path]
    if value is _ABSENT:
        return f"{path} is missing"
    if not isinstance(value, kind):
        return f"{path} is {value!r}, not a {kind.__name__}"
    if allowed and value not in allowed:
        return f"{path} is {value!r}, not one of {', '.join(allowed)}"
    return None


def _partition_problems(where: str, path: str, included, excluded) -> list[str]:
    members = PARTITIONS[path][1]
    lists = {"included": included, "excluded": excluded}
    out = []
    for name, value in lists.items():
        if value is _ABSENT:
            out.append(f"{where}{path}.{name} is missing")
        elif not isinstance(value, list) or not all(isinstance(m, str) for m in value):
            out.append(f"{where}{path}.{name} is not a list of names")
        elif len(set(value)) != len(value):
            out.append(f"{where}{path}.{name} repeats a member")
    if out:
        return out
    if both := sorted(set(included) & set(excluded)):
        out.append(f"{where}{path} both includes and excludes {', '.join(both)}")
    if neither := sorted(set(members) - set(included) - set(excluded)):
        out.append(f"{where}{path} rules on {', '.join(neither)} neither way")
    if strange := sorted((set(included) | set(excluded)) - set(members)):
        out.append(f"{where}{path} names {', '.join(strange)}")
    return out


def _alternatives(document, baseline: Ruleset, problems: list[str]) -> list[Ruleset]:
    """One ruleset per alternative; an override of a path that isn't there would leave the baseline as it is,
    and could never explain anything."""
    rows = at(document, "permutations.ordered")
    if not isinstance(rows, list):
        problems.append("permutations.ordered is no list")
        return []
    out: list[Ruleset] = []
    for n, row in enumerate(rows, 1):
        name = row.get("id") if isinstance(row, dict) else None
        if not isinstance(name, str) or not name:
            problems.append(f"alternative {n} has no id")
            continue
        where = f"{name}: "
        if name == baseline.ruleset_id or name in {r.ruleset_id for r in out}:
            problems.append(f"{where}id repeats")
        applies, override = row.get("applies_to"), row.get("override")
        if not isinstance(applies, list) or not applies or not set(applies) <= set(values.METRICS):
            problems.append(f"{where}applies_to is not a list of metrics in scope")
            applies = []
        if not isinstance(override, dict) or not override:
            problems.append(f"{where}changes nothing")
            override = {}
        changed: dict = {}
        moved: dict[str, dict] = {}
        for path, value in override.items():
            group, _, side = path.rpartition(".")
            if path in SETTINGS:
                if problem := _setting_problem(path, value):
                    problems.append(where + problem)
                else:
                    changed[SETTINGS[path][0]] = value
            elif group in PARTITIONS and side in ("included", "excluded"):
                moved.setdefault(group, {})[side] = value
            else:
                problems.append(f"{where}{path} does not exist")
        for path, sides in moved.items():
            both = [sides.get(s, at(document, f"{path}.{s}")) for s in ("included", "excluded")]
            found = _partition_problems(where, path, *both)
            problems.extend(found)
            if not found:
                changed[PARTITIONS[path][0]] = tuple(both[0])
        ruleset = replace(baseline, ruleset_id=name, ord=n, applies_to=tuple(applies), **changed)
        if override and all(getattr(ruleset, k) == getattr(baseline, k) for k in changed):
            problems.append(f"{where}equals the baseline")
        out.append(ruleset)
    return out


def _class_rules(document, problems: list[str]) -> list[tuple]:
    order = at(document, "classification.order")
    if order != LADDER:  # the order is part of the result: a reordered ladder accuses another party
        problems.append(f"classification.order is {order if order is not _ABSENT else 'missing'}, not {LADDER}")
    out = []
    for name in LADDER:
        row, severity = at(document, f"classification.classes.{name}"), at(document, f"materiality.severity_by_class.{name}")
        if not isinstance(row, dict) or not isinstance(row.get("name"), str) or not isinstance(row.get("proposes_correction"), bool):
            problems.append(f"classification.classes.{name} lacks a name or proposes_correction")
            continue
        if row.get("escalates_to") not in TARGETS:
            problems.append(f"classification.classes.{name} escalates to {row.get('escalates_to')!r}")
        if severity not in SEVERITIES:
            problems.append(f"materiality.severity_by_class.{name} is not one of {', '.join(SEVERITIES)}")
        if name == "V7" and severity != "blocking":
            problems.append("materiality.severity_by_class.V7 is not blocking")
        out.append((name, row["name"], severity, row["proposes_correction"], row.get("escalates_to")))
    return out


def _tolerance(document, problems: list[str]) -> str:
    for kind in ("count", "total"):
        if at(document, f"tolerances.by_metric_type.{kind}.type") != "exact":
            problems.append(f"tolerances.by_metric_type.{kind} is not exact")
    if at(document, "tolerances.by_metric_type.percentage_points.type") != "absolute":
        problems.append("tolerances.by_metric_type.percentage_points is not absolute")
    value = at(document, "tolerances.by_metric_type.percentage_points.value")
    try:
        band = Decimal("nan") if isinstance(value, bool) else Decimal(str(value))
    except InvalidOperation:
        band = Decimal("nan")
    if not band.is_finite() or band < 0:
        problems.append("tolerances.by_metric_type.percentage_points.value is no number from 0 up")
    return str(value)


def parse_policy(document) -> Policy:
    """A Policy, or a PolicyError that names every problem of the document."""
    if not isinstance(document, dict):
        raise PolicyError([f"a policy is a mapping, not {type(document).__name__}"])
    problems = [p for path in SETTINGS if (p := _setting_problem(path, at(document, path)))]
    if document.get("schema_version") != 1:
        problems.append(f"schema_version is {document.get('schema_version')!r}, not 1")
    version = document.get("version")
    if not isinstance(version, str) or not version:
        problems.append("version is missing")
    changed = {name: at(document, path) for path, (name, _, _) in SETTINGS.items()}
    for path, (name, _) in PARTITIONS.items():
        both = [at(document, f"{path}.{s}") for s in ("included", "excluded")]
        found = _partition_problems("", path, *both)
        problems.extend(found)
        changed[name] = tuple(both[0]) if not found else ()
    rules: list[Ruleset] = []
    if not problems:
        baseline = Ruleset(**changed)
        rules = [baseline, *_alternatives(document, baseline, problems)]
    tolerance, classes = _tolerance(document, problems), _class_rules(document, problems)
    if problems:
        raise PolicyError(problems)
    return Policy(version, tuple(rules), tolerance, tuple(classes))


def read_policy(spark: SparkSession, path: str) -> Policy:
    """A policy document of JSON, or of YAML where a YAML parser is installed, from any store Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small document
    try:
        return parse_policy(json.loads(text))
    except json.JSONDecodeError as broken:
        try:
            import yaml
        except ImportError:
            raise PolicyError([f"not JSON: {broken}"]) from None
        try:
            return parse_policy(yaml.safe_load(text))
        except yaml.YAMLError as bad:
            raise PolicyError([f"neither JSON nor YAML: {str(bad).splitlines()[0]}"]) from None


def committed_document() -> dict:
    """The committed rules as a document, the start of any other policy."""
    base = Ruleset()
    out: dict = {"schema_version": 1, "version": values.POLICY_VERSION}

    def put(path: str, value) -> None:
        node, parts = out, path.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = value

    for path, (name, _, _) in SETTINGS.items():
        put(path, getattr(base, name))
    for path, (name, members) in PARTITIONS.items():
        put(f"{path}.included", list(getattr(base, name)))
        put(f"{path}.excluded", [m for m in members if m not in getattr(base, name)])
    for kind in ("count", "total"):
        put(f"tolerances.by_metric_type.{kind}.type", "exact")
    put("tolerances.by_metric_type.percentage_points", {"type": "absolute", "value": float(DEFAULT_TOLERANCE)})
    put("classification.order", LADDER)
    for name, title, severity, proposes, target in values.CLASS_RULES:
        put(f"materiality.severity_by_class.{name}", severity)
        put(f"classification.classes.{name}", {"name": title, "proposes_correction": proposes, "escalates_to": target})
    paths = {name: path for path, (name, _, _) in SETTINGS.items()}
    groups = {name: (path, members) for path, (name, members) in PARTITIONS.items()}
    rows = []
    for name, applies, override in values.PERMUTATIONS:
        said = {}
        for key, value in override.items():
            if key in groups:
                path, members = groups[key]
                said[f"{path}.included"], said[f"{path}.excluded"] = value, [m for m in members if m not in value]
            else:
                said[paths[key]] = value
        rows.append({"id": name, "applies_to": applies, "override": said})
    put("permutations.ordered", rows)
    return json.loads(json.dumps(out))
