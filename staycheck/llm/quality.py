"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text gives a fixed list of numeric features. Each feature is cut into bins at quantiles of
the training rows. Cyclic boosting visits the features in turn and fits a shallow tree (at most three
cuts of one feature's bins) to the gradient of the log loss; the trees of a feature add up to one lookup
table. Then the pairs with the strongest remaining gradient get two-way tables in the same manner
(one cut of each feature). Scoring adds up table entries, for many rows at once.

Training takes about `sample` labelled rows, chosen by a hash of doc_id; one in five of them tells when
to stop. Only their features and labels reach the driver: `sample` rows of fixed width.

Cases: null text is an empty text and has a score like any other. Several labels of one doc_id: the
largest counts. Without labels of both kinds every score is the share of label 1, or 0.5. Repeated rows
and null doc_ids are scored like others. An empty table gives an empty result. Extra columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, sliced

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
LEARNING = 0.25
SEGMENT = 1 << 20
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "pipe", "high", "line_bytes", "stops",
            "distinct_words", "top_word", "distinct_lines", "symbol_words", "upper_words", "distinct_pairs", "longest_word",
            "odd_ends", "long_words", "capital_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\""]] = True
ENDS = frozenset(b"!$%&#*|@^~+=<>")


def _bytes(data: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for at in range(0, len(data), SEGMENT):
        out += np.bincount(np.frombuffer(data[at:at + SEGMENT], np.uint8), minlength=256)
    return out


def features(text: str) -> list[float]:
    """One number for each of FEATURES."""
    data = text.encode()
    n, seen = max(1, len(data)), _bytes(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(words))
    often: dict[bytes, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    ends = sum(c for w, c in often.items() if w[-1] in ENDS)
    upper = sum(c for w, c in often.items() if w.isupper() and len(w) > 1)
    capital = sum(c for w, c in often.items() if w.istitle())
    sizes = [len(w) for w in words]
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(len(data)), np.log1p(len(words)), sum(sizes) / m, seen[65:91].sum() / n, seen[48:58].sum() / n,
            seen[SYMBOL].sum() / n, seen[124] / n, seen[128:].sum() / n, n / max(1, len(lines)),
            (seen[46] + seen[44]) / m, len(often) / m, max(often.values(), default=0) / m,
            len(set(lines)) / max(1, len(lines)), ends / m, upper / m, pairs / max(1, len(words) - 1),
            max(sizes, default=0), sum(c for w, c in often.items() if not w[-1:].isalnum() and w[-1] < 128) / m,
            sum(s > 12 for s in sizes) / m, capital / m]


@dataclass
class Model:
    cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1) if len(x) \
            else np.zeros((0, len(self.cuts)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for f, g, t in self.pairs:
            total += t[coarse(b[:, f]), coarse(b[:, g])]
        return 1 / (1 + np.exp(-total))


def coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def leaf(gradient, weight):
    return gradient / (weight + 1.0)


def gain(gradient, weight):
    return gradient * gradient / (weight + 1.0)


def tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value for each bin of one feature, after at most two levels of cuts."""
    whole = np.full(len(gradient), leaf(gradient.sum(), weight.sum()))
    if depth == 0 or len(gradient) < 2:
        return whole
    g, w = np.cumsum(gradient), np.cumsum(weight)
    worth = gain(g[:-1], w[:-1]) + gain(g[-1] - g[:-1], w[-1] - w[:-1])
    at = int(worth.argmax()) + 1
    if worth[at - 1] <= gain(g[-1], w[-1]) + 1e-9:
        return whole
    return np.concatenate([tree(gradient[:at], weight[:at], depth - 1), tree(gradient[at:], weight[at:], depth - 1)])


def quarters(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of each of two features at once: its gain and the leaf value for each pair of bins."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, at = -1.0, (1, 1)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            a = (g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j])
            b = (w[i, j], w[i, -1] - w[i, j], w[-1, j] - w[i, j], w[-1, -1] - w[i, -1] - w[-1, j] + w[i, j])
            worth = sum(map(gain, a, b))
            if worth > best:
                best, at = worth, (i + 1, j + 1)
    out = np.empty_like(gradient)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for cols in (slice(0, at[1]), slice(at[1], None)):
            out[rows, cols] = leaf(gradient[rows, cols].sum(), weight[rows, cols].sum())
    return best - gain(g[-1, -1], w[-1, -1]), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """x: features, y: labels 0 or 1, in a fixed order."""
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Model([np.empty(0)] * n_features, float(np.log(p / (1 - p))), [np.zeros(BINS)] * n_features)
    model = Model([np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)])
    p = y.mean()
    model.base = float(np.log(p / (1 - p)))
    model.tables = [np.zeros(BINS) for _ in range(n_features)]
    b = model.bins(x)
    small = coarse(b)
    watch = np.arange(len(y)) % 5 == 0
    learn = ~watch if 20 <= len(y) else np.ones(len(y), bool)
    total = np.full(len(y), model.base)

    def pulls():
        q = 1 / (1 + np.exp(-total))
        return (y - q) * learn, q * (1 - q) * learn

    def loss():
        on = watch if 20 <= len(y) else learn
        return float(np.logaddexp(0, np.where(y[on] > 0, -total[on], total[on])).mean())

    def boost(step, state, restore):
        """Rounds until the watched loss has not fallen for ten of them; the best state stays."""
        nonlocal total
        best, kept, idle = loss(), (state(), total.copy()), 0
        for _ in range(rounds):
            step()
            now = loss()
            if now < best - 1e-5:
                best, kept, idle = now, (state(), total.copy()), 0
            else:
                idle += 1
                if idle == 10:
                    break
        restore(kept[0])
        total = kept[1]

    def each_feature():
        nonlocal total
        for f in range(n_features):
            g, w = pulls()
            t = LEARNING * tree(np.bincount(b[:, f], g, BINS), np.bincount(b[:, f], w, BINS))
            model.tables[f] = model.tables[f] + t
            total = total + t[b[:, f]]

    boost(each_feature, lambda: list(model.tables), lambda kept: setattr(model, "tables", kept))

    def two_way(values, f, g):
        return np.bincount(small[:, f] * PAIR_BINS + small[:, g], values, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)

    g0, w0 = pulls()
    ranked = sorted(combinations(range(n_features), 2), key=lambda fg: -quarters(two_way(g0, *fg), two_way(w0, *fg))[0])
    model.pairs = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for f, g in ranked[:pairs]]

    def each_pair():
        nonlocal total
        for k, (f, g, t) in enumerate(model.pairs):
            pull, weight = pulls()
            step = LEARNING * quarters(two_way(pull, f, g), two_way(weight, f, g))[1]
            model.pairs[k] = (f, g, t + step)
            total = total + step[small[:, f], small[:, g]]

    boost(each_pair, lambda: list(model.pairs), lambda kept: setattr(model, "pairs", kept))
    return model


FEATURE_COLUMNS = "features array<double>"


def featured(rows: DataFrame, schema: str) -> DataFrame:
    """The columns that schema names and, in place of text, its features."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))],
                                             [*names, "features"])

    return rows.mapInArrow(run, f"{schema}, {FEATURE_COLUMNS}")


def fit(docs: DataFrame, labels: DataFrame, labelled: Column, sample: int = SAMPLE) -> Model:
    """Learn from the rows of labels (doc_id, quality) that `labelled` names, about `sample` of them."""
    known = labels.where(labelled & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < share)
    rows = doc_rows(docs).join(chosen, "doc_id").select("doc_id", "row_key", "quality", "text")
    got = featured(rows, "doc_id long, row_key long, quality int").collect()
    got.sort(key=lambda r: (r["doc_id"], r["row_key"]))
    x = np.array([r["features"] for r in got]).reshape(len(got), len(FEATURES))
    return train(x, np.array([r["quality"] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, score (higher: label 1 likelier), one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sent.value.score(x), pa.float64())],
                ["doc_id", "row_key", "score"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, row_key long, score double")
