"""Language ID: averaged hashed subword embeddings and a linear softmax.

Every run of 2 to 4 bytes of the lower-cased text (white space counts as one blank, so runs mark word
edges) is hashed to an embedding; a text is the mean of its embeddings, and a linear softmax names the
language. Embeddings and weights are learned together by stochastic gradient descent in numpy, from
about `per_language` documents of each language, and at most all but one of `calibration` of them. Every
other labelled document is scored with that model in Spark: on those a temperature fits the confidence,
and the rejection threshold is the confidence that a share of at most `rejected` of rightly named documents
is expected to miss. The driver sees sums and a fixed histogram of the confidence for each temperature.
With fewer than 1 / `rejected` rightly named documents to calibrate on, even the lowest confidence seen
says nothing about so small a share, and no confidence is rejected.

As the model is linear, a hash's embedding and the weights fold into one row of class scores, so that
scoring a whole text is a lookup for each run and one mean.

Cases: a text without a letter (null and empty ones too) is `und` with score 0 and rejected. With one
learned language that one is named; with no labelled row every text is `und`. Repeated rows and null
doc_ids are scored like others. An empty table gives an empty result. Extra columns are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, sliced

SIZES = (2, 3, 4)
HASH_BITS = 15
WIDTH = 16
PER_LANGUAGE = 600
CALIBRATION = 4
REJECTED = 0.0005
EPOCHS = 10
TEMPERATURES = np.geomspace(0.002, 20, 80)
# The histogram is over the log odds of the named language; what lies outside counts in the end bins.
LOWEST, BINS_A_UNIT, BINS = -8, 16, 512
LOSS_UNIT, LOSS_CAP = 1e-7, -np.log(1e-12)  # losses are summed as whole numbers, alike in any order
SEGMENT = 1 << 18
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
SPACE = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def runs(data: np.ndarray, bits: int = HASH_BITS) -> Iterator[np.ndarray]:
    """For each size, the hash of every run of that many bytes; a longer run continues a shorter one."""
    h = np.zeros(len(data), np.uint32)
    for size in range(1, max(SIZES) + 1):
        if len(data) < size:
            return
        h = h[:len(data) - size + 1]
        h = (h ^ data[size - 1:]) * FACTORS[size - 1]
        h ^= h >> np.uint32(15)
        if size in SIZES:
            yield ((h + np.uint32(size)) * FACTORS[0]) >> np.uint32(32 - bits)


def prepared(text: str) -> bytes:
    return f" {text.lower()} ".encode().translate(SPACE)


def counts(text: str) -> np.ndarray:
    """How often each hash occurs in a whole text."""
    data = np.frombuffer(prepared(text), np.uint8)
    out = np.zeros(1 << HASH_BITS, np.int64)
    for at in range(0, len(data), SEGMENT):
        for size, h in zip(SIZES, runs(data[at:at + SEGMENT + max(SIZES) - 1])):
            out += np.bincount(h[:SEGMENT], minlength=1 << HASH_BITS)
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # class scores by hash, one row for each class
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of class scores per text. Texts are scored some at a time, long ones in segments."""
        parts = [prepared(t) for t in texts]
        totals, ns = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        group, held = [], 0
        for i, part in enumerate(parts):
            for at in range(0, len(part), SEGMENT):  # a segment owns the runs that begin in it
                group.append((i, part[at:at + SEGMENT + max(SIZES) - 1], min(SEGMENT, len(part) - at)))
                held += len(group[-1][1])
                if held >= SEGMENT:
                    self._add(group, totals, ns)
                    group, held = [], 0
        self._add(group, totals, ns)
        return totals / np.maximum(ns, 1)[:, None] + self.bias

    def _add(self, group, totals, ns):
        if not group:
            return
        data = np.frombuffer(b"".join(g[1] for g in group), np.uint8)
        sizes = np.array([len(g[1]) for g in group])
        owner, begins = np.array([g[0] for g in group]), np.cumsum(sizes) - sizes
        owned = np.array([g[2] for g in group])
        for size, h in zip(SIZES, runs(data)):
            n = np.minimum(sizes - size + 1, owned)
            some = n > 0
            edges = np.stack([begins[some], begins[some] + n[some]], axis=1).reshape(-1)
            np.add.at(ns, owner[some], n[some])
            h = h.astype(np.intp)
            for c, scores in enumerate(self.scores):
                values = np.append(scores.take(h), np.float32(0))
                np.add.at(totals[:, c], owner[some], np.add.reduceat(values, edges, dtype=np.float64)[::2])

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, calibrated confidence, rejected) of each text."""
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [(self.languages[b], float(q[b]), bool(q[b] < self.threshold)) if any(map(str.isalpha, t)) else ("und", 0.0, True)
                for t, b, q in zip(texts, best.tolist(), p)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str], width: int = WIDTH,
          epochs: int = EPOCHS, rate: float = 100.0) -> Model:
    """rows: language, the hashes a text holds, how often each occurs; in a fixed order. The model isn't
    calibrated."""
    number = {x: n for n, x in enumerate(languages)}
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.1, (1 << HASH_BITS, width)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    shares = [(n / n.sum()).astype(np.float32) for _, _, n in rows]
    target = np.array([number[r[0]] for r in rows])

    def means(chosen):
        at = np.concatenate(([0], np.cumsum([len(rows[i][1]) for i in chosen[:-1]]))).astype(np.int64)
        hashes, share = np.concatenate([rows[i][1] for i in chosen]), np.concatenate([shares[i] for i in chosen])
        return np.add.reduceat(vectors[hashes] * share[:, None], at, axis=0), hashes, share

    for epoch in range(epochs if rows else 0):
        step = rate * (1 - epoch / epochs)
        for chosen in np.array_split(rng.permutation(len(rows)), -(-len(rows) // 32)):
            mean, hashes, share = means(chosen)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), target[chosen]] -= 1
            error /= len(chosen)
            back = error @ weights.T
            weights -= step / 20 * mean.T @ error
            bias -= step / 20 * error.sum(axis=0)
            of = np.repeat(np.arange(len(chosen)), [len(rows[i][1]) for i in chosen])
            change = step * share[:, None] * back[of]
            for d in range(width):
                vectors[:, d] -= np.bincount(hashes, change[:, d], 1 << HASH_BITS)
    return Model(languages, np.ascontiguousarray((vectors @ weights).T), bias, 1.0, 0.0)


def tally(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each temperature, the loss of some rows, then how many rightly named ones are in each bin."""
    out = np.zeros((len(TEMPERATURES), 1 + BINS), np.int64)
    rows = np.arange(len(target))
    best = logits.argmax(axis=1)
    right = best == target
    for k, temperature in enumerate(TEMPERATURES):
        z = logits / temperature
        loss = np.minimum(np.logaddexp.reduce(z, axis=1) - z[rows, target], LOSS_CAP)
        out[k, 0] = np.rint(loss / LOSS_UNIT).astype(np.int64).sum()
        top = z[rows, best]
        z[rows, best] = -np.inf
        odds = (top - np.logaddexp.reduce(z, axis=1))[right]
        bins = np.clip(np.floor((odds - LOWEST) * BINS_A_UNIT), 0, BINS - 1).astype(np.int64)
        out[k, 1:] = np.bincount(bins, minlength=BINS)
    return out


def cut(tallied: np.ndarray, rejected: float = REJECTED) -> tuple[float, float]:
    """Temperature and threshold. Below the r-th lowest of n confidences another one falls with a chance of
    r / (n + 1); the threshold is the lower edge of the bin of the highest r at which that is `rejected`
    or less."""
    k = int(np.argmin(tallied[:, 0]))
    upto = np.cumsum(tallied[k, 1:])
    rank = math.floor(rejected * (int(upto[-1]) + 1))
    odds = LOWEST + int(np.searchsorted(upto, rank)) / BINS_A_UNIT
    return float(TEMPERATURES[k]), 1 / (1 + math.exp(-odds)) if rank else 0.0


def calibrated(rows: DataFrame, model: Model, rejected: float = REJECTED) -> Model | None:
    """The model with temperature and threshold of all rows (text, lang) that hold a letter; none without
    such a row."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(len(TEMPERATURES) * (1 + BINS), np.int64)
        number, n = {x: i for i, x in enumerate(own.languages)}, 0
        for batch in sliced(batches):
            some = [(t, number[x]) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
                    if any(map(str.isalpha, t))]
            if some:
                n += len(some)
                total += tally(own.logits([t for t, _ in some]), np.array([x for _, x in some])).reshape(-1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *total[at]], pa.int64())], ["at", "n"])

    sums = rows.select("text", "lang").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(sums["at"].to_pylist(), sums["n"].to_pylist()))
    if not got.pop(-1, 0):
        return None
    tallied = np.zeros(len(TEMPERATURES) * (1 + BINS), np.int64)
    tallied[list(got)] = list(got.values())
    temperature, threshold = cut(tallied.reshape(len(TEMPERATURES), -1), rejected)
    return replace(model, temperature=temperature, threshold=threshold)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        hashes, often = [], []
        for text in batch.column("text").to_pylist():
            n = counts(text)
            hashes.append(np.flatnonzero(n).astype(np.int32))
            often.append(n[hashes[-1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(hashes, pa.list_(pa.int32())),
             pa.array(often, pa.list_(pa.int64()))], ["doc_id", "lang", "hashes", "often"])


def fit(docs: DataFrame, labelled: Column, per_language: int = PER_LANGUAGE, calibration: int = CALIBRATION) -> Model:
    """Learn from text and lang of the rows that `labelled` names, about per_language of each language
    (each row by a hash of its doc_id against its language's share), and calibrate on all the others. A
    language of few rows is learned from all of them; with no other rows those calibrate too."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return Model([], np.zeros((0, 1 << HASH_BITS)), np.zeros(0), 1.0, 0.0)
    shares = {lang: 1.0 if n <= 4 * calibration else min(1 - 1 / calibration, per_language / n) for lang, n in seen.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    learned = place < share[F.col("lang")]
    sample = rows.where(learned).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    got = sample.mapInArrow(_features, "doc_id long, lang string, hashes array<int>, often array<long>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (str(got["lang"][i]), str(got["doc_id"][i])))
    model = train([(got["lang"][i].as_py(), got["hashes"][i].values.to_numpy(), got["often"][i].values.to_numpy())
                   for i in order], sorted(seen))
    return calibrated(rows.where(~learned), model) or calibrated(rows, model) or model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, lang_pred, score, rejected, one row per row of docs; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches):
            found = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                ["doc_id", "row_key", "lang_pred", "score", "rejected"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, row_key long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those whose language is rejected; a filter in place, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches):
            found = own.predict([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([not rejected for _, _, rejected in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
