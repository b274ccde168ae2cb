"""Text helpers shared by the checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycheck import values


def let(value: Column, body) -> Column:
    """`body` applied to `value`, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_key(text: Column) -> Column:
    """The one label matching rule: lower case, letters digits and single spaces only."""
    kept = F.regexp_replace(F.lower(F.trim(text)), "[^0-9a-z ]+", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def parse_iso_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_whole_number(text: Column) -> Column:
    """Null for text that is no whole number, or one that no bigint holds."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def opaque_ref(text: Column) -> Column:
    return F.coalesce(text.rlike("^g_[0-9a-f]{8,32}$"), F.lit(False))


def pseudonym(salt: str, identity: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), identity).cast("binary"), 256)
    return F.concat(F.lit("g_"), F.substring(digest, 1, 16))


def _may_match(text: Column, name: str) -> Column:
    """A cheap test every match of the pattern passes, so most text never meets the pattern."""
    needs = values.REDACTION_NEEDS.get(name)
    if not needs:
        return F.lit(True)
    found = text.contains(needs[0])
    for part in needs[1:]:
        found = found | text.contains(part)
    return found


def redact(text: Column) -> Column:
    """Every match replaced by its placeholder; later patterns see the text earlier ones left."""
    for name, pattern in values.REDACTION_PATTERNS:
        text = let(text, _replacer(name, pattern))
    return text


def _replacer(name: str, pattern: str):
    return lambda t: F.when(_may_match(t, name), F.regexp_replace(
        t, "(?U)" + pattern, f"[redacted:{name}]")).otherwise(t)


def _counter(name: str, pattern: str):
    return lambda t: F.when(_may_match(t, name), F.regexp_count(
        t, F.lit("(?U)" + pattern))).otherwise(0)


def redaction_counts(text: Column) -> dict[str, Column]:
    """Matches per pattern, each counted on the text the earlier patterns left."""
    counts = {}
    for name, pattern in values.REDACTION_PATTERNS:
        counts[name] = let(text, _counter(name, pattern))
        text = let(text, _replacer(name, pattern))
    return counts


def month_in_name(name: Column) -> Column:
    """The first YYYY-MM token in a name that is a real month."""
    tokens = F.regexp_extract_all(name, F.lit("[0-9]{4}-[0-9]{2}"), F.lit(0))
    real = F.filter(tokens, lambda t: t.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"))
    return F.get(real, F.lit(0))


def month_of_report(name: Column) -> Column:
    """The text after the last underscore of the stem, when it is a period; else null."""
    tail = F.regexp_extract(name, r"_([^_.]+)\.[^.]+$", 1)
    return F.when(tail.rlike("^[0-9]{4}(-(0[1-9]|1[0-2]|Q[1-4]))?$"), tail)


def transpose_digits(value: Column) -> Column:
    """First two digits swapped; null where that is not a mistyped count."""
    whole = value == F.floor(value)
    digits = F.abs(value).cast("bigint").cast("string")
    a, b = F.substring(digits, 1, 1), F.substring(digits, 2, 1)
    swapped = F.concat(b, a, F.substring(digits, 3, 38)).cast("bigint")
    return F.when(whole & (F.length(digits) >= 2) & (a != b), swapped)
