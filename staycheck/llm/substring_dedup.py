"""Substring dedup: Rabin-Karp hashes of every window of 20 words, counted per hash bucket in Spark.

1. Each input task hashes the windows of its documents. Of a window that repeats inside the task only
   the first is sent to its bucket of hashes; the others are already known to repeat and go straight to
   their group of documents. So a passage that a third of all documents hold costs its bucket one entry for
   each task. Entries travel packed, one row for each task and bucket or group.
2. Each bucket is sorted by hash; every window but the first (by doc_id, then start) is marked.
3. Marks meet their documents by groups of documents, overlapping windows merge into maximal
   intervals, and the remaining words are joined.

Hashes have 64 bits (bucket number and 56 sent bits): n windows hold n * n / 2**65 chance collisions.

Cases: null text has no words. A text of fewer words than a window keeps all of them. Rows that repeat
doc_id and text get the same result and never remove each other; rows that repeat a doc_id with another
text are told apart by a 16-bit tag of the text and ordered by it. Null doc_ids come first. An empty
table gives an empty result. Extra columns are ignored.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows

WINDOW = 20
SEGMENT_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
TASK_WINDOWS = 1 << 20
BUCKET_WINDOWS = 1 << 20
GROUP_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).min

_random = np.random.default_rng(20)
BYTE_VALUES = _random.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    def run(b):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes of ranges from prefix sums, with the powers it has needed so far."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, *powers(base, 1024)

    def hashes(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if len(values) > len(self.up):
            self.up, self.down = powers(self.base, 2 * len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=sums[1:])
        return mixed((sums[last] - sums[first]) * self.down[first])


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a buffer of texts that begin at bounds[:-1]."""
    space = SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[full] = ~space[full]
    full = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    last[full] = ~space[full]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def window_hashes(data: np.ndarray, bounds: np.ndarray, rollers, window: int):
    """(hash, text number, start word) of every window of the texts in a buffer."""
    starts, ends = word_spans(data, bounds)
    words = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # some words at a time: the powers stay few
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT_BYTES, "right")))
        lo = starts[at]
        words[at:to] = rollers[0].hashes(BYTE_VALUES[data[lo:ends[to - 1]]], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    text = np.searchsorted(bounds, starts, "right") - 1
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.flatnonzero(text[:len(words) - window + 1] == text[window - 1:])
    out = np.empty(len(i), np.uint64)
    for a in range(0, len(i), SEGMENT_BYTES):
        part = i[a:a + SEGMENT_BYTES]
        lo, hi = part[0], part[-1] + window
        out[a:a + len(part)] = rollers[1].hashes(words[lo:hi], part - lo, part - lo + window)
    return out, text[i], i - np.searchsorted(text, text[i])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes, each by byte planes so that small numbers cost little."""
    import zstandard

    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
        out.append(f"{x.dtype.str} {len(x)} ".encode())
        out.append(planes)
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n, _ = raw[at:at + 40].split(b" ", 2)
        at += len(kind) + len(n) + 2
        kind, n = np.dtype(kind.decode()), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.empty(0, kind))
        at += n * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _buffers(batches: Iterator[pa.RecordBatch]):
    """Some rows at a time: ids, row keys, the bytes of all texts, and the bounds of each text in them."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
            yield ids[at:to], keys[at:to], data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
            at = to


def tag_of(keys: np.ndarray) -> np.ndarray:
    return (keys & 0xFFFF).astype(np.uint16)


def group_of(ids: np.ndarray, tags: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64) ^ (tags.astype(np.uint64) << np.uint64(48))) % np.uint64(groups)).astype(np.int32)


def _hash_windows(window: int, bits: int, groups: int):
    """Batches of documents to packed rows: by bucket (0 and more) the first windows of this task's
    documents, with hashes; those that repeat among them need none and go to their group of documents, as
    bucket -1 - group."""
    low = np.uint64(64 - bits)

    def emit(ids, tags, parts):
        order = np.lexsort((tags, ids))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ids, tags = ids[order], tags[order]
        hashes, texts, starts = (np.concatenate(x) for x in zip(*parts))
        texts = rank[texts]
        by_text = np.argsort(texts, kind="stable")
        hashes, texts, starts = hashes[by_text], texts[by_text], starts[by_text]
        by_hash = np.argsort(hashes, kind="stable")
        again = np.zeros(len(hashes), bool)
        again[by_hash[1:]] = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
        buckets = (hashes >> low).astype(np.uint32)
        rows = []
        first = np.flatnonzero(~again)
        first = first[np.argsort(buckets[first], kind="stable")]
        names, at = np.unique(buckets[first], return_index=True)
        for name, part in zip(names.tolist(), np.split(first, at[1:])):
            docs, begin, counts = np.unique(texts[part], return_index=True, return_counts=True)
            begins = steps(starts[part])
            begins[begin] = starts[part][begin]
            arrays = [steps(ids[docs]), tags[docs], counts.astype(np.uint32), begins.astype(np.uint32)]
            rows.append((name, pack(*arrays), hashes[part].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()))
        known = np.flatnonzero(again)
        rows += [(-1 - name, marks, b"") for name, marks in _by_group(ids[texts[known]], tags[texts[known]], starts[known], groups)]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = Roller(BASES[0]), Roller(BASES[1])
        ids, tags, parts, seen, held = [], [], [], set(), 0

        def flush():
            rows = emit(np.concatenate(ids), np.concatenate(tags), parts)
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), (pa.int32(), pa.binary(), pa.binary()))],
                    ["bucket", "docs", "hashes"])

        for own, keys, data, bounds in _buffers(batches):
            hashes, texts, starts = window_hashes(data, bounds, rollers, window)
            fresh = np.zeros(len(own), bool)
            for n, pair in enumerate(zip(own.tolist(), keys.tolist())):
                if pair not in seen:
                    seen.add(pair)
                    fresh[n] = True
            use = fresh[texts]
            texts = texts[use].astype(np.int32) + np.int32(sum(map(len, ids)))
            parts.append((hashes[use], texts, starts[use].astype(np.int32)))
            ids.append(own)
            tags.append(tag_of(keys))
            held += int(use.sum())
            if held >= TASK_WINDOWS:
                yield from flush()
                ids, tags, parts, seen, held = [], [], [], set(), 0
        if held:
            yield from flush()

    return run


def _spread(docs: bytes):
    """ids, tags and starts of each window of a packed row."""
    ids, tags, counts, begins = unpack(docs)
    begins = begins.astype(np.int64)
    first = np.cumsum(counts) - counts
    total = np.cumsum(begins)
    base = np.repeat(total[first] - begins[first], counts)
    return np.repeat(np.cumsum(ids), counts), np.repeat(tags, counts), total - base


def _by_group(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Marked windows packed by group of documents."""
    group = group_of(ids, tags, groups)
    order = np.lexsort((starts, tags, ids, group))
    names, at = np.unique(group[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, at[1:])):
        if len(part):
            yield name, pack(steps(ids[part]), tags[part], steps(starts[part]).astype(np.int32))


def _mark(groups: int):
    """One bucket's rows to the windows that have an earlier one, packed by group of documents. What has
    come for a group passes through."""
    def run(key, table):
        if key[0].as_py() < 0:
            names = np.full(table.num_rows, -1 - key[0].as_py(), np.int32)
            return pa.table({"part": pa.array(names), "marks": table.column("docs")})
        first = []
        for docs, sent in zip(table.column("docs").to_pylist(), table.column("hashes").to_pylist()):
            ids, tags, starts = _spread(docs)
            hashes = np.zeros((len(ids), 8), np.uint8)
            hashes[:, :7] = np.frombuffer(sent, np.uint8).reshape(-1, 7)
            first.append((hashes.reshape(-1).view(np.uint64), ids, tags, starts))
        hashes, ids, tags, starts = (np.concatenate(x) for x in zip(*first))
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        some = np.zeros(len(order), bool)
        some[1:] |= same
        some[:-1] |= same
        order = order[some]
        order = order[np.lexsort((starts[order], tags[order], ids[order], hashes[order]))]
        hashes, ids, tags, starts = hashes[order], ids[order], tags[order], starts[order]
        rows: list[tuple[int, bytes]] = []
        if len(order):
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            least = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            later = (ids != ids[least]) | (tags != tags[least]) | (starts != starts[least])
            rows = list(_by_group(ids[later], tags[later], starts[later], groups))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()),
                         "marks": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _group_texts(groups: int):
    """Batches of documents to one compressed row for each group of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for ids, keys, data, bounds in _buffers(batches):
            group = group_of(ids, tag_of(keys), groups)
            order = np.argsort(group, kind="stable")
            names, at = np.unique(group[order], return_index=True)
            rows, raw = [], data.tobytes()
            for name, part in zip(names.tolist(), np.split(order, at[1:])):
                texts = b"".join([raw[bounds[i]:bounds[i + 1]] for i in part.tolist()])
                sizes = (bounds[part + 1] - bounds[part]).astype(np.int64)
                rows.append((name, pack(ids[part], keys[part], sizes), zstandard.compress(texts, 3)))
            for n in range(0, len(rows), 64):
                cols = list(zip(*rows[n:n + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                    ["part", "docs", "texts"])

    return run


def _cut_out(window: int, schema: pa.Schema):
    """One group of documents with its marks to intervals and remaining words."""
    def run(key, left, right):
        import zstandard

        marks = [unpack(x) for x in right.column("marks").to_pylist()]
        where: dict = {}
        if marks:
            ids = np.concatenate([np.cumsum(m[0]) for m in marks])
            tags = np.concatenate([m[1] for m in marks])
            starts = np.concatenate([np.cumsum(m[2], dtype=np.int64) for m in marks])
            order = np.lexsort((starts, tags, ids))
            ids, tags, starts = ids[order], tags[order], starts[order]
            new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))))
            where = {(ids[a], tags[a]): (a, b) for a, b in itertools.pairwise([*new.tolist(), len(ids)])}
        out = [[] for _ in schema.names]
        for docs, texts in zip(left.column("docs").to_pylist(), left.column("texts").to_pylist()):
            own, keys, sizes = unpack(docs)
            data, at = zstandard.decompress(texts), 0
            for i, key, tag, size in zip(own.tolist(), keys.tolist(), tag_of(keys).tolist(), sizes.tolist()):
                words = data[at:at + size].split()
                at += size
                a, b = where.get((i, tag), (0, 0))
                spans = []
                if a < b:
                    cover = np.zeros(len(words) + 1, np.int32)
                    mine = starts[a:b]
                    np.add.at(cover, mine, 1)
                    np.add.at(cover, mine + window, -1)
                    cut = np.cumsum(cover)[:-1] > 0
                    edge = np.flatnonzero(np.diff(cut, prepend=False, append=False))
                    spans = [{"first": f, "last": t} for f, t in edge.reshape(-1, 2).tolist()]
                    kept = itertools.compress(words, (~cut).tolist())
                else:
                    kept = words
                for column, value in zip(out, (None if i == NO_ID else i, key, len(words), spans,
                                               b" ".join(kept).decode())):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS,
                    group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, row_key, n_words, removed (array of word intervals, last exclusive), kept_text, one row
    per row of docs. bucket_windows and group_bytes bound what one task call holds."""
    rows = doc_rows(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (size // 6 // bucket_windows).bit_length())
    groups = 1 + size // group_bytes
    hashed = rows.mapInArrow(_hash_windows(window, bits, groups), "bucket int, docs binary, hashes binary")
    marks = hashed.groupBy("bucket").applyInArrow(_mark(groups), "part int, marks binary")
    texts = rows.mapInArrow(_group_texts(groups), "part int, docs binary, texts binary")
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()),
                        ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        ("kept_text", pa.string())])
    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(
        _cut_out(window, schema),
        "doc_id long, row_key long, n_words long, removed array<struct<first: long, last: long>>, kept_text string")
