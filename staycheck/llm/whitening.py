"""Embedding whitening: principal components by spectrum slicing, each vector's coordinates scaled to variance 1.

Vectors are whole numbers (quantised embeddings). Spark sums each dimension exactly, then the products of the
centred entries; whole numbers near the mean keep these exact too, in any order, while a sum stays below 2**53.
The covariance (dimensions squared, whatever the number of vectors) goes to the driver. There the inertia of
its shifts, read from the pivots of a Bunch-Kaufman LDL' factorisation, counts the eigenvalues above a point;
bisection by these counts isolates each leading eigenvalue, Rayleigh quotient iteration started in its interval
converges to it, and two counts around the result certify which one it is. Eigenvalues no count can tell apart
share an interval and get an orthonormal basis by inverse iteration. One more pass sums the products of the
whitened coordinates and compares them with the identity.

Cases: vectors whose length isn't the commonest (of equally common ones the greatest) are left out, as empty
and null ones and ones with an entry that is null or 2**53 and more are. Components whose variance can't be told from zero (fewer vectors
than dimensions, constant dimensions) don't exist; with no component (one vector, an empty table, equal vectors
only) the result is empty. A deviation beyond a long is null. Repeated rows and null ids are rows like others.
Each component's largest entry (the first of equals) is positive. Extra columns are left behind.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
BLOCK_ROWS = 2048
EPS = np.finfo(float).eps
ALPHA = (1 + 17**0.5) / 8
GREATEST = 1 << 53
UNIT = float(1 << 40)  # sums of whitened products travel as whole numbers of this fraction


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of LDL' (Bunch and Kaufman)."""
    a, positive = a.copy(), 0
    while len(a):
        below = np.abs(a[1:, 0])
        most = below.max(initial=0.0)
        r, pair = 0, False
        if most and abs(a[0, 0]) < ALPHA * most:
            r = 1 + int(below.argmax())
            across = np.abs(a[r])
            across[r] = 0
            rest = across.max()
            if abs(a[0, 0]) * rest >= ALPHA * most * most:
                r = 0
            elif abs(a[r, r]) < ALPHA * rest:
                pair = True
        at = 1 if pair else 0
        if r != at:
            a[[r, at]] = a[[at, r]]
            a[:, [r, at]] = a[:, [at, r]]
        if pair:  # a pair of pivots has one of each sign
            positive += 1
            side = a[2:, :2]
            a = a[2:, 2:] - side @ np.linalg.inv(a[:2, :2]) @ side.T
        else:
            positive += a[0, 0] > 0
            a = a[1:, 1:] - (np.outer(a[1:, 0], a[1:, 0] / a[0, 0]) if a[0, 0] else 0)
    return int(positive)


class Slicer:
    """Leading eigenpairs of a symmetric positive semidefinite matrix."""

    def __init__(self, a: np.ndarray):
        self.a, self.d = a, len(a)
        self.norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
        self.least = 4 * max(self.d, 1) * EPS * self.norm  # what rounding can move an eigenvalue by
        self.random = np.random.default_rng(12)

    def above(self, x: float) -> int:
        return inertia(self.a - x * np.eye(self.d))

    def leading(self, k: int) -> list[tuple[float, np.ndarray]]:
        """Up to k eigenpairs that are surely positive, by falling eigenvalue."""
        n = self.above(self.least) if self.norm else 0
        k, out = min(k, n), []
        spans = [(self.least, self.norm * (1 + 1e-9), n, 0)]
        while spans and len(out) < k:
            low, high, n_low, n_high = spans.pop()
            if n_low == n_high:
                continue
            if n_low - n_high == 1 and (pair := self._single(low, high, n_low)):
                out.append(pair)
                continue
            if high - low <= self.least:
                out.extend(self._cluster((low + high) / 2, n_low - n_high))
                continue
            mid = (low + high) / 2
            n_mid = self.above(mid)
            spans += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
        out = sorted(out, key=lambda x: -x[0])[:k]
        return list(zip([e for e, _ in out], self._orthonormal([v for _, v in out])))

    def _single(self, low: float, high: float, number: int):
        """The eigenpair of that number, alone in (low, high], or nothing if it can't be certified yet."""
        x, v = (low + high) / 2, self.random.standard_normal(self.d)
        v = self._solved(x, self._solved(x, v / np.linalg.norm(v)))
        for _ in range(12):
            x = float(v @ self.a @ v)
            if not low < x <= high:
                return None
            if np.linalg.norm(self.a @ v - x * v) <= self.least / 4:
                break
            v = self._solved(x, v)
        v = self._solved(x, v)
        x = float(v @ self.a @ v)
        by = self.least + float(np.linalg.norm(self.a @ v - x * v))
        if self.above(x - by) != number or self.above(x + by) != number - 1:
            return None
        return x, v

    def _cluster(self, x: float, n: int) -> list[tuple[float, np.ndarray]]:
        own: list[tuple[float, np.ndarray]] = []
        for _ in range(n):
            v = self.random.standard_normal(self.d)
            for _ in range(4):
                v = self._solved(x, v)
                for _, u in own:
                    v = v - (u @ v) * u
                v /= np.linalg.norm(v)
            own.append((float(v @ self.a @ v), v))
        return own

    def _solved(self, x: float, v: np.ndarray) -> np.ndarray:
        shifted = self.a - x * np.eye(self.d)
        try:
            y = np.linalg.solve(shifted, v)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(shifted + max(self.norm, 1e-300) * EPS * np.eye(self.d), v)
        return y / np.linalg.norm(y)

    @staticmethod
    def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for v in vectors:
            for _ in range(2):
                for u in out:
                    v = v - (u @ v) * u
            v = v / np.linalg.norm(v)
            out.append(v if v[np.abs(v).argmax()] > 0 else -v)
        return out


@dataclass
class Model:
    n: int
    sums: list[int]
    middle: np.ndarray  # whole number next to the mean, by dimension
    values: np.ndarray  # variances of the components, falling
    vectors: np.ndarray  # a column for each
    trace: float
    identity_error: float = 0.0

    def __post_init__(self):
        self.excess = [s - self.n * int(m) for s, m in zip(self.sums, self.middle.tolist())]  # sum of x - middle
        self.rest = np.array([float(Fraction(e, self.n)) for e in self.excess])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle).astype(float) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact."""
        z = x - self.middle
        most = float(np.abs(z).max(initial=0)) * self.n + max(map(abs, self.excess), default=0)
        if most * most * max(x.shape[1], 1) < 2.0**62:
            out = ((self.n * z - np.array(self.excess, np.int64)) ** 2).sum(axis=1).tolist()
        else:
            out = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.excess)) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _usable(vectors: DataFrame, vec_id: str, x: str) -> tuple[DataFrame, int]:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(x).cast("array<long>").alias("x"))
    rows = rows.where(f"size(x) > 0 AND forall(x, c -> c IS NOT NULL AND abs(c) < {GREATEST})")
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.where(F.size("x") == d), d


def _total(rows: DataFrame, partials, d: int) -> dict[int, int]:
    """Exact sums by place of the whole numbers that partials makes of each task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partials(_matrices(batches, d))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38))], ["at", "n"])

    summed = rows.mapInArrow(run, "at long, n decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"))
    return {r["at"]: int(r["n"]) for r in summed.collect()}


def _entry_sums(d: int):
    """Sums of each dimension, then the number of vectors."""
    def partials(parts) -> list[int]:
        total = [0] * (d + 1)
        for _, x in parts:
            sums = (x >> 24).sum(axis=0).tolist(), (x & 0xFFFFFF).sum(axis=0).tolist()
            for i, (high, low) in enumerate(zip(*sums)):
                total[i] += (high << 24) + low
            total[d] += len(x)
        return total if total[d] else []

    return partials


def _product_sums(d: int, of, unit: float):
    """Products of all pairs of columns of of(x), then the columns; a whole number of 1 / unit for each."""
    upper = np.triu_indices(d)

    def partials(parts) -> list[int]:
        total, columns, n = np.zeros((d, d)), np.zeros(d), 0
        for _, x in parts:
            z = of(x)
            total += z.T @ z
            columns += z.sum(axis=0)
            n += len(x)
        return list(map(int, np.rint(np.concatenate([total[upper], columns]) * unit).tolist())) if n else []

    return partials


def _square(total: dict[int, int], d: int) -> tuple[np.ndarray, np.ndarray]:
    upper, out = np.triu_indices(d), np.zeros((d, d))
    out[upper] = [float(total[i]) for i in range(len(upper[0]))]
    out = np.triu(out) + np.triu(out, 1).T
    return out, np.array([float(total[len(upper[0]) + i]) for i in range(d)])


def fit(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", x: str = "x") -> Model | None:
    """Model of all usable vectors; None where there is no component."""
    rows, d = _usable(vectors, vec_id, x)
    sums = _total(rows, _entry_sums(d), d) if d else {}
    if not sums:
        return None
    n = sums.pop(d)
    middle = [round(Fraction(sums[i], n)) for i in range(d)]
    held = np.array(middle, np.int64)
    products, _ = _square(_total(rows, _product_sums(d, lambda x: (x - held).astype(float), 1.0), d), d)
    rest = np.array([float(Fraction(sums[i], n) - middle[i]) for i in range(d)])
    covariance = products / n - np.outer(rest, rest)
    pairs = Slicer(covariance).leading(components)
    if not pairs:
        return None
    model = Model(n, [sums[i] for i in range(d)], held, np.array([e for e, _ in pairs]),
                  np.stack([v for _, v in pairs], axis=1), float(np.trace(covariance)))
    k = len(pairs)
    whitened, columns = _square(_total(rows, _product_sums(k, model.whiten, UNIT), d), k)
    columns = columns / UNIT / n
    error = whitened / UNIT / n - np.outer(columns, columns) - np.eye(k)
    model.identity_error = float(np.abs(error).max())
    return model


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Model | None, vec_id: str = "vec_id", x: str = "x") -> DataFrame:
    """A row for each usable vector and component (from 1, by falling variance): COLUMNS."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    rows, d = _usable(vectors, vec_id, x)
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions times components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.values)
        explained = own.values / own.trace
        for part, x in _matrices(batches, d):
            m = len(x)
            of = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, own.n), pa.int64()), pa.array(own.deviations(x), pa.int64()).take(pa.array(of)),
                 pa.array(own.whiten(x).reshape(-1), pa.float64()), pa.array(np.tile(explained, m), pa.float64()),
                 pa.array(np.full(m * k, own.identity_error), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, COLUMNS)
