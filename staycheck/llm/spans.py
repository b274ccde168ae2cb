"""Places of regular expression matches, from built-in functions only.

The parts between matches and the matches themselves both come back as arrays; their running lengths
are the places, in code points.
"""

PLACE = "struct<start: int, end: int, match: string, before: string, after: string>"
CHUNK = 128


def bound(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value, which is worked out once. A lambda that reads anything but
    lambda variables would work that out again for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def placed(items: str, advance: str, made: str, kind: str) -> str:
    """SQL for an array of `made`, of type kind, for each item x of an array of structs; `at` in it is the sum
    of advance (over x) of the items before.

    An array grows by copying, so places are summed up in chunks: first the chunks' sums, then the items
    within each, and the copies stay in proportion to the items."""
    def grown(over: str, begin: str, item: str, by: str, out: str, of: str) -> str:
        return (f"aggregate({over}, named_struct('at', {begin}, 'out', cast(array() AS array<{of}>)), (s, {item}) -> "
                f"named_struct('at', s.at + {by}, 'out', concat(s.out, array({out}))), s -> s.out)")

    chunks = f"transform(sequence(0, (size(z) - 1) div {CHUNK}), c -> slice(z, int(c * {CHUNK} + 1), {CHUNK}))"
    sums = f"transform(ch, p -> aggregate(p, 0L, (s, x) -> s + {advance}))"
    starts = grown(sums, "0L", "v", "v", "s.at", "bigint")
    within = grown("p", "o", "x", advance, f"get(transform(array(s.at), at -> {made}), 0)", kind)
    return bound(items, "z", bound(chunks, "ch", f"flatten(zip_with(ch, {starts}, (p, o) -> {within}))"))


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"'


def find(text: str, pattern: str) -> str:
    """SQL for the leftmost, non-overlapping matches of a Java pattern that never matches nothing: an
    array of PLACE; before: up to 24 characters since the last match, after: up to 1."""
    p = quoted(pattern)
    zipped = (f"zip_with(zip_with(parts, regexp_extract_all({text}, {p}, 0), (g, m) -> struct(g, m)), "
              "slice(parts, 2, 1000000000), (x, n) -> struct(x.g AS g, x.m AS m, n AS n))")
    items = bound(f"split({text}, {p}, -1)", "parts", f"filter({zipped}, x -> x.m IS NOT NULL)")
    made = ("named_struct('start', int(at + length(x.g)), 'end', int(at + length(x.g) + length(x.m)), "
            "'match', x.m, 'before', right(x.g, 24), 'after', left(x.n, 1))")
    return (f"CASE WHEN {text} RLIKE {p} THEN {placed(items, 'length(x.g) + length(x.m)', made, PLACE)} "
            f"ELSE cast(array() AS array<{PLACE}>) END")


def span_list(spans: str, order: str) -> str:
    """SQL for 'kind:start:end,...' of an array of structs kind, rank, start, end; order: the fields to
    sort by."""
    fields = ", ".join(f"x.{f}" for f in order.split())
    keyed = f"transform({spans}, x -> struct({fields}, x.end, x.kind AS name, x.start AS begin))"
    return f"array_join(transform(array_sort({keyed}), x -> concat_ws(':', x.name, x.begin, x.end)), ',')"
