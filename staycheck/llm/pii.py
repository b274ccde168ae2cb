"""Personal data: candidates from generous generators, scored by boosted trees, cut at a calibrated
threshold. Only DataFrame and SQL functions look at texts.

The base patterns (email, ip, card, phone) always count. The generators propose more: anything around an at
sign or its spelled-out forms (handle), groups of seven and more digits with separators (number), bank account
numbers by country (iban), days (date), names after titles (name) and house numbers with a street (street).
They overlap the base spans and each other. A candidate has features of its form (kind, digits, separators,
how it begins, a checksum or day that is valid) and of its context (words before it that tell of a call, a
letter, a bank, a birth, a home or a person, words that tell of something else, the characters next to it).

The trees learn from `examples` made by rule (EXAMPLES of them, a bounded sample): spans of each kind in forms
the base patterns miss, in contexts that tell or don't, and look-alikes such as order numbers, prices, days
without a birth and account numbers with a wrong checksum. They go through the same generators and features.
The threshold is the one at which, on the half of the examples that isn't learned from, `precision` of what
passes is personal data. It is then calibrated on all documents: their candidates that look like a base span
and fail its test (checksum, octet, number of digits, host without a dot) are known not to be one, and the
threshold rises until at most 1 - precision of these pass. The driver gets one count for each combination of
features. What looks like a base span and fails its test is never added.

Candidates above the threshold are added unless they overlap a base span; of added ones that overlap the
longest of near neighbours stays (of equals, the first kind).

Cases: null text is an empty text; texts without findings have empty lists. Without candidates in the
documents the threshold is that of the examples. Repeated rows and null doc_ids are handled like others. An
empty table gives an empty result. Extra columns are ignored.
"""

import random
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows
from staycheck.llm.spans import bound, find

TREES = 60
LEARNING = 0.3
PRECISION = 0.98
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "date", "name", "street", "handle", "number")
EXAMPLES = 6000
NEAR = 6
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Sr"

# What counts of each base kind is fixed. The patterns are written so that a run of characters is looked
# at once: they begin where a run begins, or where the last match ended, and don't give characters back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": r"(?<![\w.%+-])[\w.%+-]{1,64}+\x20?(?:@|[(\[]at[)\]])\x20?[\w-]{1,63}+(?:(?:\.|\x20dot\x20)[\w-]{1,63}+){0,4}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])[0-9]{1,4}+([./-])[0-9]{1,2}+\1[0-9]{1,4}+(?![0-9]|[./-][0-9])",
    "name": rf"(?<![\p{{L}}\w])(?:{TITLES})\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?:\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+){{0,2}}+",
    "street": r"(?<![\w./-])[0-9]{1,5}+\x20(?:\p{Lu}[\p{L}'-]{1,30}+\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Square|Way)\b"
              r"|\p{Lu}[\p{L}-]{1,30}?(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}+[a-z]?+"
              r"|\b(?:rue|avenue|calle|plaza|paseo)\x20(?:(?:de|du|des|la|del)\x20){0,2}\p{Lu}[\p{L}-]{1,30}+,?\x20[0-9]{1,4}+",
    "number": r"(?<![\w.])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,23}+(?!\w)",
}
_OCTET = "(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5]))"
_DIGITS = "regexp_replace(x.match, '[^0-9]', '')"
_OCTETS = f"x.match RLIKE r'^{_OCTET}(?:[.]{_OCTET}){{3}}$'"
# digits from the right; every second one doubled, and 9 taken off what passes 9
_LUHN = (f"aggregate(transform(filter(split(reverse({_DIGITS}), ''), d -> d <> ''), (d, i) -> cast(d AS int) * (1 + i % 2) "
         f"- IF(i % 2 = 1 AND cast(d AS int) > 4, 9, 0)), 0, (s, d) -> s + d) % 10 = 0")
KEEP = {"email": "true", "ip": _OCTETS, "card": _LUHN, "phone": f"length({_DIGITS}) BETWEEN 8 AND 15"}
_TOLD = {  # words right before a candidate, by what they tell of
    "call": "phone|tel|call|mobile|cell|fax|whatsapp|ring|dial|handy|telefon|anruf|rufen|móvil|teléfono|llam[ae]|téléphone|appel",
    "letter": "mail|write|correo|courriel|escrib|schreib|écri",
    "bank": "iban|account|konto|compte|cuenta|bank|banque|banco|transfer|card|visa",
    "birth": "born|birth|dob|geboren|geburtstag|geb|née?|naissance|nacid|nacimiento",
    "home": "lives?|address|home|resid|wohn|adresse|dirección|domicil|habite|vive",
    "person": "patient|client|customer|guest|signed|dear|contact",
}
_OTHER = ("order|invoice|version|isbn|ticket|ref|page|no|nr|total|price|serial|model|build|batch|part|code|sold|counted|year|"
          "bestellung|rechnung|seite|preis|commande|facture|prix|pedido|factura|precio|id")


def _before(words: str) -> str:
    return f"IF(x.before RLIKE r'(?iu)(?<![\\p{{L}}])(?:{words})[\\p{{L}}]{{0,8}}[^\\p{{L}}.]{{0,4}}(?:[\\p{{L}}]{{1,4}}[^\\p{{L}}.]{{1,3}}){{0,2}}$', 1, 0)"


# letters as numbers from 10 up, the first four characters last; what is left of 97
_IBAN = ("aggregate(filter(split(concat(substring({0}, 5), left({0}, 4)), ''), c -> c <> ''), 0, (s, c) -> "
         "IF(c BETWEEN '0' AND '9', s * 10 + ascii(c) - 48, s * 100 + ascii(c) - 55) % 97) = 1"
         ).format("regexp_replace(x.match, ' ', '')")
_YEAR = "cast(regexp_extract(x.match, '([0-9]{4})', 1) AS string)"

# whole numbers, each of few values
FEATURES = {
    "kind": f"array_position(array({', '.join(repr(k) for k in KINDS[len(BASE):])}), x.kind)",
    "digits": f"least(length({_DIGITS}), 20)",
    "separators": "least(length(regexp_replace(x.match, '[^ ()/-]', '')), 6)",
    "dots": "least(length(regexp_replace(x.match, '[^.]', '')), 4)",
    "parens": "IF(contains(x.match, '('), 1, 0)",
    "begins": "CASE WHEN startswith(x.match, '+') THEN 3 WHEN startswith(x.match, '00') THEN 2 WHEN x.match RLIKE '^[(]?0' THEN 1 ELSE 0 END",
    "spelled": r"IF(x.match RLIKE r'[(\[]at[)\]]', 2, 0) + IF(x.match RLIKE r'[.]\p{L}{2}|\x20dot\x20', 1, 0)",
    "letters": "IF(x.match RLIKE '^[A-Za-z]', 1, 0)",
    "valid": f"CASE x.kind WHEN 'iban' THEN IF({_IBAN}, 1, 0) WHEN 'date' THEN IF({_YEAR} BETWEEN '1920' AND '2012', 1, 0) ELSE 0 END",
    **{f"told_{name}": _before(words) for name, words in _TOLD.items()},
    "other": _before(_OTHER) + r" + IF(x.before RLIKE r'[$€£#]\x20?$', 1, 0)",
    "touches": "IF(x.before RLIKE r'\\w$', 1, 0) + IF(x.after RLIKE r'^[\\w%€$]', 2, 0)",
}
# a candidate that is a base span in form
_BASE_FORM = (f"(x.match RLIKE r'^{_LOCAL}++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++$') OR {_OCTETS} "
              f"OR (x.match RLIKE r'^[0-9](?:[ -]?[0-9]){{15,18}}+$' AND {_LUHN}) "
              f"OR (x.match RLIKE r'^[+][0-9][ ().0-9-]+[0-9]$' AND length({_DIGITS}) BETWEEN 8 AND 15)")
# a candidate that looks like one and isn't: no dot in the host, an octet over 255, a wrong checksum or count
_BROKEN_FORM = (f"(x.match RLIKE r'^{_LOCAL}++@[A-Za-z0-9-]++$') OR (x.match RLIKE r'^[0-9]++(?:[.][0-9]++){{3}}$' AND NOT {_OCTETS}) "
                f"OR (x.match RLIKE r'^[0-9](?:[ -]?[0-9]){{15,18}}+$' AND NOT {_LUHN}) "
                f"OR (x.match RLIKE r'^[+][0-9][ ().0-9-]+[0-9]$' AND NOT length({_DIGITS}) BETWEEN 8 AND 15)")
_SPAN = "array<struct<kind: string, rank: int, start: int, end: int>>"


def _base(text: str) -> str:
    parts = [f"transform(filter({find(text, PATTERNS[k])}, x -> {KEEP[k]}), "
             f"x -> struct('{k}' AS kind, {n} AS rank, x.start, x.end))" for n, k in enumerate(BASE)]
    return f"cast(concat({', '.join(parts)}) AS {_SPAN})"


def _candidates(text: str) -> str:
    parts = [f"transform({find(text, PATTERNS[k])}, x -> struct('{k}' AS kind, {KINDS.index(k)} AS rank, x.start, x.end, "
             "x.match, x.before, x.after))" for k in KINDS[len(BASE):]]
    return f"concat({', '.join(parts)})"


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base spans and candidates with their features; is_base: the candidate has the form
    of a base span; is_broken: it has the looks and fails the test."""
    rows = doc_rows(docs)
    # no pattern can match without one of these; what begins like a title is told by a few first letters
    some = "(text RLIKE r'[0-9@]' OR contains(text, 'at)') OR contains(text, 'at]') OR text RLIKE r'[DFHMPS]\\p{L}{1,7}\\.?\\x20\\p{Lu}')"
    rows = rows.select("doc_id", "row_key", F.expr(f"IF({some}, text, '')").alias("text"))
    rows = rows.select("doc_id", "row_key", F.expr(_base("text")).alias("base"), F.expr(_candidates("text")).alias("found"))
    # no expression inside a lambda reads another column: it would be worked out for each element
    named = ", ".join(f"{sql} AS {name}" for name, sql in FEATURES.items())
    return rows.select("doc_id", "row_key", "base", F.expr(
        f"transform(found, x -> struct(x.kind AS name, x.rank, x.start, x.end, {named}, "
        f"{_BASE_FORM} AS is_base, {_BROKEN_FORM} AS is_broken))").alias("found"))


@dataclass
class Model:
    """Trees of two levels: (feature, cut, feature below, cut, feature above, cut, four values)."""
    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = 2.0

    def score(self, x: dict) -> float:
        total = self.base + sum(v[0 if x[g] < d else 1] if x[f] < c else v[2 if x[h] < e else 3]
                                for f, c, g, d, h, e, v in self.trees)
        return float(1 / (1 + np.exp(-total)))

    def sql(self) -> str:
        """The score of a candidate x, 0 to 1."""
        terms = [repr(self.base)]
        for f, c, g, d, h, e, v in self.trees:
            terms.append(f"IF(x.{f} < {c}, IF(x.{g} < {d}, {v[0]!r}D, {v[1]!r}D), IF(x.{h} < {e}, {v[2]!r}D, {v[3]!r}D))")
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def train(cells: list[dict], trees: int = TREES, precision: float = PRECISION, names: tuple = tuple(FEATURES)) -> Model:
    """cells: feature values, n and positive (candidates of these values, base spans among them) and half."""
    x = np.array([[c[f] for f in names] for c in cells]).reshape(-1, len(names))
    n, pos = (np.array([c[k] for c in cells], float) for k in ("n", "positive"))
    learn = np.array([c["half"] == 0 for c in cells], bool)
    if not pos[learn].sum() or not (n - pos)[learn].sum():
        return Model()
    p = pos[learn].sum() / n[learn].sum()
    model = Model(float(np.log(p / (1 - p))))
    total = np.full(len(n), model.base)

    def cut(g, w, rows):
        """Best (gain, feature, cut) on some cells; a cut below everything where none helps."""
        best = (-1.0, names[0], -1)
        for f, name in enumerate(names):
            values = x[rows, f]
            for c in np.unique(values)[1:]:
                low = values < c
                a, b = (g[rows][low].sum(), w[rows][low].sum()), (g[rows][~low].sum(), w[rows][~low].sum())
                best = max(best, (float(a[0] ** 2 / (a[1] + 1) + b[0] ** 2 / (b[1] + 1)), name, int(c)))
        return best

    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, w = (pos - n * q) * learn, n * q * (1 - q) * learn
        _, f, c = cut(g, w, np.arange(len(n)))
        low = x[:, names.index(f)] < c
        sides, values, step = [], [], np.zeros(len(n))
        for side in (low, ~low):
            rows = np.flatnonzero(side)
            _, h, d = cut(g, w, rows) if len(rows) else (0, names[0], -1)
            sides += [h, d]
            below = x[:, names.index(h)] < d
            for part in (side & below, side & ~below):
                values.append(LEARNING * float(g[part].sum() / (w[part].sum() + 1)))
                step[part] = values[-1]
        model.trees.append((f, c, *sides, tuple(values)))
        total = total + step
    score = 1 / (1 + np.exp(-total))
    check = np.flatnonzero(~learn)
    order = check[np.argsort(-score[check], kind="stable")]
    right, seen = np.cumsum(pos[order]), np.cumsum(n[order])
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores stay together
    good = np.flatnonzero(last & (right >= precision * seen) & (seen >= 20))
    if len(good):
        model.threshold = float(score[order][good[-1]])
    return model


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """doc_id, text, first, last, personal: texts of made-up words that hold one span (first to last, code
    points), and whether it is personal data. Made by rule, the same each time."""
    rng = random.Random(10)

    def word() -> str:
        return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def name() -> str:
        return word().capitalize()

    def iban(right: bool) -> str:
        country, own = rng.choice(["DE", "FR", "ES", "GB", "NL"]), digits(rng.choice([14, 16, 18, 20]))
        rest = int("".join(str(int(c, 36)) for c in own + country + "00") ) % 97
        check = f"{(98 - rest if right else 50 - rest) % 97:02d}"
        whole = country + check + own
        return whole if rng.random() < 0.5 else " ".join(whole[i:i + 4] for i in range(0, len(whole), 4))

    def number() -> str:
        sep = rng.choice([" ", "-", "."])
        return rng.choice([
            lambda: f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"00{rng.randint(1, 99)} {digits(2)} {digits(7)}", lambda: f"0{digits(3)} {digits(6)}", lambda: f"0{digits(3)}-{digits(3)}-{digits(3)}",
            lambda: digits(rng.choice([8, 9, 10, 11]))])()

    def date() -> str:
        sep, y = rng.choice("./-"), rng.randint(1925, 2011)
        return rng.choice([f"{rng.randint(1, 28)}{sep}{rng.randint(1, 12)}{sep}{y}", f"{y}{sep}{rng.randint(1, 12):02d}{sep}{rng.randint(1, 28):02d}"])

    def handle() -> str:
        at = rng.choice([" (at) ", " [at] ", "(at)", "[at]"])
        return word() + at + word() + rng.choice([" dot ", "."]) + rng.choice(["org", "com", "de", "net"])

    def street() -> str:
        return rng.choice([f"{rng.randint(1, 400)} {name()} {rng.choice(['Street', 'Road', 'Avenue', 'Lane'])}", f"{name()}straße {rng.randint(1, 99)}",
                           f"{name()}weg {rng.randint(1, 99)}", f"rue de {name()} {rng.randint(1, 99)}", f"calle {name()} {rng.randint(1, 99)}"])

    def titled() -> str:
        return rng.choice(["Mr", "Mrs", "Dr.", "Frau", "Herr", "Madame", "Prof."]) + " " + name() + (" " + name() if rng.random() < 0.5 else "")

    def told(*kinds: str) -> str:
        words = [w.split("[")[0].rstrip("?") for k in kinds for w in _TOLD[k].split("|")]
        return rng.choice(words) + rng.choice(["", ":", " " + rng.choice(["is", "at", "me", "us", "on", "in"])])

    def against() -> str:
        return rng.choice(_OTHER.split("|")) + rng.choice(["", ":", " no", " #"])

    made = [  # personal, what comes before, the span
        (True, lambda: told("call"), number), (True, lambda: told("call", "letter", "person"), handle), (True, word, handle),
        (True, lambda: told("bank"), lambda: iban(True)), (True, word, lambda: iban(True)), (True, lambda: told("birth"), date),
        (True, lambda: told("person", "home"), titled), (True, word, titled), (True, lambda: told("home"), street), (True, word, street),
        (False, against, number), (False, word, number), (False, lambda: rng.choice("$€£"), lambda: f"{digits(3)}.{digits(3)}.{digits(3)}"),
        (False, against, lambda: digits(rng.choice([7, 9, 12, 13, 14]))), (False, word, lambda: f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"),
        (False, word, date), (False, against, date), (False, against, lambda: iban(False)), (False, word, lambda: iban(False)),
        (False, word, lambda: f"{digits(2)} @ {digits(2)}"), (False, word, lambda: f"{word()} @ {word()}"), (False, against, lambda: f"{word()}@{digits(2)}"),
    ]
    rows = []
    for i in range(n):
        personal, before, span = made[i % len(made)]
        head = " ".join(word() for _ in range(rng.randint(2, 6))) + " " + before() + " "
        found = span()
        rows.append((i, head + found + " " + " ".join(word() for _ in range(3)), len(head), len(head) + len(found), personal))
    return spark.createDataFrame(rows, "doc_id long, text string, first int, last int, personal boolean")


def _counted(found: DataFrame, *keys) -> list:
    """Candidates x by keys and features, counted."""
    return found.groupBy(*keys, *[F.col(f"x.{f}") for f in FEATURES]).agg(F.count(F.lit(1)).alias("n")).collect()


def learned(spark: SparkSession, precision: float = PRECISION) -> Model:
    """Trees and threshold of the examples."""
    known = examples(spark)
    found = proposed(known).select("doc_id", F.explode("found").alias("x")).join(known.drop("text"), "doc_id")
    hit = (F.col("x.start") < F.col("last")) & (F.col("first") < F.col("x.end"))
    found = found.where(hit & ~F.col("x.is_base") & ~F.col("x.is_broken"))
    half = F.expr("cast(doc_id div 100 % 2 AS int)")
    cells: dict[tuple, list[int]] = {}
    for r in _counted(found, half.alias("half"), F.col("personal")):
        cell = cells.setdefault((r["half"], *(r[f] for f in FEATURES)), [0, 0])
        cell[0] += r["n"]
        cell[1] += r["n"] * r["personal"]
    return train([dict(zip(("half", *FEATURES), k)) | {"n": n, "positive": p} for k, (n, p) in sorted(cells.items())],
                 precision=precision)


def calibrated(model: Model, broken: list[dict], precision: float = PRECISION) -> Model:
    """The model with its threshold raised until at most 1 - precision of the look-alikes that fail a test pass.
    broken: feature values and n, over all documents."""
    rows = sorted(((model.score(c), c["n"]) for c in broken), reverse=True)
    allowed, threshold = (1 - precision) * sum(n for _, n in rows), model.threshold
    passed = 0
    for score, n in rows:
        passed += n
        if score >= threshold and passed > allowed:
            threshold = float(np.nextafter(score, 3))
    return replace(model, threshold=threshold)


def fit(docs: DataFrame, precision: float = PRECISION) -> Model:
    """Learn from the examples, calibrate on the look-alikes of all documents."""
    model = learned(docs.sparkSession, precision)
    # outer, as Spark would otherwise work the candidates out once more to see whether there are any
    found = proposed(docs).select(F.explode_outer("found").alias("x")).where("x.is_broken")
    return calibrated(model, [r.asDict() for r in _counted(found)], precision)


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, base (spans of the base kinds), spans (all that are to be redacted), each an array
    of kind, rank, start, end (end exclusive, code points), one row per row of docs."""
    rows = proposed(docs).select("doc_id", "row_key", "base", F.expr(
        f"array_sort(transform(filter(found, x -> NOT x.is_base AND NOT x.is_broken AND {model.sql()} >= {model.threshold!r}), "
        "x -> struct(x.start, -x.end AS last, x.rank, x.end, x.name AS kind)))").alias("likely"))
    # a candidate against the last span of each base kind that begins before it ends, found by halving
    step = "transform(sequence(0, 30), k -> 1 << (30 - k))"
    last = (f"aggregate({step}, 0, (at, by) -> IF(at + by <= size(own) AND get(own, at + by - 1).start < x.end, at + by, at))")
    free = f"NOT coalesce(get(own, {last} - 1).end > x.start, false)"
    likely = "likely"
    for k in BASE:
        likely = bound(f"named_struct('own', array_sort(filter(base, b -> b.kind = '{k}')), 'some', {likely})", "both",
                       bound("both.own", "own", f"filter(both.some, x -> {free})"))
    # of neighbours that overlap the longest stays
    beaten = ("exists(slice(all, greatest(i + 1 - {0}, 1), 2 * {0} + 1), y -> y.start < x.end AND x.start < y.end AND "
              "(y.end - y.start > x.end - x.start OR (y.end - y.start = x.end - x.start AND y.rank < x.rank)))").format(NEAR)
    kept = bound(likely, "all", f"filter(all, (x, i) -> NOT {beaten})")
    return rows.select("doc_id", "row_key", "base", F.expr(
        f"IF(size(likely) = 0, base, cast(concat(base, transform({kept}, x -> struct(x.kind, x.rank, x.start, x.end))) AS {_SPAN}))"
    ).alias("spans"))
