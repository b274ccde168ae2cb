"""The baseline reading of the rules and its alternatives, as plain rows."""

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from staycheck import values


@dataclass(frozen=True)
class Ruleset:
    ruleset_id: str = "BASELINE"
    ord: int = 0
    applies_to: tuple = tuple(values.METRICS)
    status_in: tuple = ("CHECKED_OUT", "IN_HOUSE")
    rate_in: tuple = ("BAR", "CORP", "GOV", "OTA", "GROUP", "COMP")
    denominator: str = "room_nights_available"
    occ_month_basis: str = "occupied_night"
    exclude_out_of_order: bool = True
    day_use_counts_room_nights: bool = False
    day_use_counts_guests: bool = True
    counts: str = "guests"
    include_children: bool = True
    nat_month_basis: str = "arrival_month"


_SETTINGS = {f.name for f in fields(Ruleset)} - {"ruleset_id", "ord", "applies_to"}
_CHOICES = {
    "denominator": {"room_nights_available", "rooms_available"},
    "occ_month_basis": {"occupied_night", "arrival_month", "departure_month"},
    "nat_month_basis": {"occupied_night", "arrival_month", "departure_month"},
    "counts": {"guests", "arrivals", "room_nights"},
}


def rulesets(permutations=None, baseline: Ruleset = Ruleset()) -> list[Ruleset]:
    """Baseline first, then one ruleset per permutation in committed order.

    An override of a setting that does not exist is refused: it would leave the baseline unchanged
    and the alternative could never explain anything.
    """
    out = [baseline]
    for ord_, (pid, applies_to, override) in enumerate(
        values.PERMUTATIONS if permutations is None else permutations, start=1
    ):
        unknown = set(override) - _SETTINGS
        if unknown:
            raise ValueError(f"{pid} overrides unknown settings: {sorted(unknown)}")
        if not set(applies_to) <= set(values.METRICS):
            raise ValueError(f"{pid} applies to metrics out of scope")
        for name, allowed in _CHOICES.items():
            if override.get(name, getattr(baseline, name)) not in allowed:
                raise ValueError(f"{pid}: {name}={override[name]!r}")
        changed = {k: tuple(v) if isinstance(v, list) else v for k, v in override.items()}
        out.append(replace(baseline, ruleset_id=pid, ord=ord_, applies_to=tuple(applies_to), **changed))
    ids = [r.ruleset_id for r in out]
    if len(set(ids)) != len(ids):
        raise ValueError("ruleset ids repeat")
    return out


RULESET_SCHEMA = (
    "ruleset_id string, ord int, applies_to array<string>, "
    "status_in array<string>, rate_in array<string>, denominator string, occ_month_basis string, "
    "exclude_out_of_order boolean, day_use_counts_room_nights boolean, "
    "day_use_counts_guests boolean, counts string, include_children boolean, nat_month_basis string"
)


def rulesets_table(spark: SparkSession, rules: list[Ruleset] | None = None) -> DataFrame:
    rows = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items()}
            for r in (rules or rulesets())]
    return spark.createDataFrame(rows, RULESET_SCHEMA)


def check_class_order(order: list[str]) -> None:
    """The ladder order is part of the result, so a reordered one is refused."""
    expected = [row[0] for row in values.CLASS_RULES]
    if list(order) != expected:
        raise ValueError(f"classification order {order} is not {expected}")
