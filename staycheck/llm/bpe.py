"""Byte-level BPE in two tiers.

Text is split by the tokenizer's pattern. A pre-token that is itself in the vocabulary resolves with
one probe of a minimal perfect hash (hash and displace; the stored key is compared, so strangers are
recognised). Others start as single bytes in a linked list, and a heap of adjacent pairs by (rank,
place) gives the next merge. Results of distinct pre-tokens are remembered in each worker, up to a fixed
number.

Cases: null text is an empty text and has no ids. Special tokens don't exist: their strings are
ordinary text. Rows are independent: repeated rows, null doc_ids and long texts need nothing special.
An empty table gives an empty result. Extra columns are ignored.
"""

import array
import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, kept

MEMORY = 200_000
BATCH_BYTES = 4 << 20
BUCKET = 4
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * GOLDEN & MASK)) * GOLDEN & MASK
    return (x >> 32) * n >> 32


SEEDS = np.arange(1, 257, dtype=np.uint64)


def _slots(own: np.ndarray, first: int, n: int) -> np.ndarray:
    """_slot of each hash for 256 seeds from first on."""
    x = (own ^ ((SEEDS + np.uint64(first - 1)) * np.uint64(GOLDEN))[:, None]) * np.uint64(GOLDEN)
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Keys in as many slots as there are keys: slot of a key, or of some other key for a stranger."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // BUCKET)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in map(_hash, keys):
            groups[h % self.buckets].append(h)
        self.seeds, used = [0] * self.buckets, np.zeros(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            own, first = np.array(groups[b], np.uint64), 1
            while True:
                slots = _slots(own, first, n)
                fits = ~used[slots].any(axis=1)
                fits[fits] = (np.diff(np.sort(slots[fits], axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                first += len(SEEDS)
            at = int(fits.argmax())
            self.seeds[b] = first + at
            used[slots[at]] = True
        free = iter(np.flatnonzero(~used).tolist())  # single keys take the slots that are left
        for b in order:
            if len(groups[b]) == 1:
                self.seeds[b] = -1 - next(free)

    def slot(self, key: bytes) -> int:
        h = _hash(key)
        seed = self.seeds[h % self.buckets]
        return -1 - seed if seed < 0 else _slot(h, seed, self.n)


class Vocabulary:
    """Ranks by token and tokens by rank. What crosses to the executors is this object: its size is
    that of the vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.table = ranks, PerfectHash(list(ranks))
        self.key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self.keys, self.ids = [b""] * len(ranks), [0] * len(ranks)
        for token, rank in ranks.items():
            at = self.table.slot(token)
            self.keys[at], self.ids[at] = token, rank

    def rank(self, token: bytes) -> int | None:
        at = self.table.slot(token)
        return self.ids[at] if self.keys[at] == token else None

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank(piece)
        return self.merge(piece) if whole is None else [whole]

    def merge(self, piece: bytes) -> list[int]:
        """after: where the part that starts here ends, 0 once it has gone into the one before it. A
        heap entry is rank, start and end of two neighbours in one number."""
        n, rank = len(piece), self.ranks.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n)), []
        for a in range(n - 1):
            r = rank(piece[a:a + 2])
            if r is not None:
                heap.append(r << 64 | a << 32 | a + 2)
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            a, end = x >> 32 & 0xFFFFFFFF, x & 0xFFFFFFFF
            b = after[a]
            if not b or b == n or after[b] != end:
                continue  # one of the two has changed meanwhile
            after[a], after[b] = end, 0
            before[end] = a
            p = before[a]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, r << 64 | p << 32 | end)
            if end < n and (r := rank(piece[a:after[end]])) is not None:
                heapq.heappush(heap, r << 64 | a << 32 | after[end])
        out, a = [], 0
        while a < n:
            out.append(rank(piece[a:after[a]]))
            a = after[a]
        return out

    def tokens(self) -> list[bytes]:
        out = [b""] * (1 + max(self.ids, default=-1))
        for token, rank in zip(self.keys, self.ids):
            out[rank] = token
        return out


class _Pieces(dict):
    """Packed ids by pre-token, found when first asked for. Two generations of at most MEMORY entries:
    what is still in use when the younger is full moves on, the rest is forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = array.array("i", self.vocabulary.encode(piece.encode())).tobytes()
        self[piece] = out
        return out

    def age(self):
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()


def _pieces(sent) -> _Pieces:
    """One memory for each worker process and vocabulary, kept from task to task."""
    return kept(("bpe", sent.value.key), lambda: _Pieces(sent.value))


def _encode(vocabulary, pattern: str, decoded: bool):
    """Batches of documents to ids, and to what the ids stand for: both in one worker, so that no second
    one is needed and ids don't travel back to Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces, split = _pieces(vocabulary), regex.compile(pattern).findall
        tokens = vocabulary.value.tokens() if decoded else []

        def flush(ids, keys, parts):
            sizes = np.fromiter((len(p) // 4 for p in parts), np.int32, len(parts))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = np.frombuffer(b"".join(parts), np.int32)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                       pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
            if decoded:
                columns.append(pa.array(list(_decoded(values, offsets.tolist(), tokens)), pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "ids", "decoded"][:len(columns)])

        for batch in batches:
            held, ids, keys, parts = 0, [], [], []
            for i, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(),
                                    batch.column("text")):
                text = text.as_py()
                ids.append(i)
                keys.append(key)
                parts.append(b"".join(map(pieces.__getitem__, split(text))))
                held += len(text)
                if held >= BATCH_BYTES:
                    yield flush(ids, keys, parts)
                    held, ids, keys, parts = 0, [], [], []
                pieces.age()
            if ids:
                yield flush(ids, keys, parts)
            pa.default_memory_pool().release_unused()

    return run


def _decoded(ids: np.ndarray, bounds: list[int], tokens: list[bytes]) -> Iterator[bytes]:
    for first, last in itertools.pairwise(bounds):
        yield b"".join([tokens[i] for i in ids[first:last].tolist()])


def _decode(vocabulary, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value.tokens()
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_pylist()
            at = 0
            while at < batch.num_rows:
                to, held = at, 0
                while to < batch.num_rows and held < BATCH_BYTES:
                    held += 4 * (bounds[to + 1] - bounds[to])
                    to += 1
                rest = [batch.column(n).slice(at, to - at) for n in names]
                texts = pa.array(list(_decoded(ids, bounds[at:to + 1], tokens)), pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, texts], [*names, "decoded"])
                at = to

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> DataFrame:
    """doc_id, row_key, ids of the whole text, one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return doc_rows(docs).mapInArrow(_encode(sent, pattern, False), "doc_id long, row_key long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> DataFrame:
    """doc_id, row_key, ids and decoded (the bytes that these ids stand for), one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return doc_rows(docs).mapInArrow(_encode(sent, pattern, True),
                                     "doc_id long, row_key long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """decoded (the bytes that ids stand for) in place of ids; the other columns stay."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in encoded.columns if c != "ids"]
    schema = encoded.select(*names).withColumn("decoded", F.lit(b"")).schema
    return encoded.mapInArrow(_decode(sent, names), schema)


def ids_digest(ids: str = "ids"):
    """Hex digest of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
