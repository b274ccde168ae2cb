"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: lower case, ASCII punctuation removed, white space made single
blanks, UTF-8 bytes. An item of L bytes may occur with up to k = L * rate edits. Cut into k + 1 pieces,
every such occurrence holds at least one piece unchanged, so an automaton over all pieces finds all
places to look at; Myers' bit-parallel distance then verifies each of them.

Pieces have at least `piece` bytes: where an item is too short for that, its k is smaller. An item
shorter than one piece has no edits, and counts only where it stands between blanks or text ends.

The items are the query set. They go to the tasks in blocks of at most block_bytes (counted first),
one pass over the documents each.

Cases: null and empty texts match nothing; null items and items that are empty once normalised are never
found. Items with equal texts are all reported. Repeated rows are reported each. A document may hold
several items. Empty tables give an empty result. Extra columns are ignored, or kept by the filter.
"""

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, sliced

RATE = 0.05
PIECE = 12
BLOCK_BYTES = 8 << 20
PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
HITS = "item_id long, distance int, occurrences int, first_word int, last_word int"


def normalised(text: str) -> str:
    """One character for each byte."""
    return b" ".join(text.lower().encode().translate(None, PUNCTUATION).split()).decode("latin-1")


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return out


def myers(text: str, peq: dict[str, int], size: int) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text, first end where it is reached). The
    whole pattern is one column of bits."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        right = down | ~(d | up)
        left = up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1
        up = (left | ~(x | right)) & full
        down = right & x & full
        if score < best:
            best, end = score, at
    return best, end


class Finder:
    """Items made ready to be found in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, piece: int):
        import ahocorasick

        self.items, places = [], defaultdict(list)
        for item_id, text in items:
            s = normalised(text or "")
            if not s:
                continue
            k = max(0, min(int(len(s) * rate), len(s) // piece - 1))
            n = len(self.items)
            self.items.append((item_id, s, k, masks(s), masks(s[::-1])))
            cuts = [i * len(s) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places[s[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()
        self.whole_words = {n for n, item in enumerate(self.items) if len(item[1]) < piece}

    def find(self, text: str) -> list[dict]:
        if not self.items:
            return []
        s = normalised(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(s):
            for n, offset in where:
                diagonals[n].add(end + 1 - size - offset)
        out = []
        for n in sorted(diagonals):
            item_id, item, k, peq, back = self.items[n]
            found, spots = [], []
            for d in sorted(diagonals[n]):  # neighbouring diagonals are one place to look at
                if spots and d <= spots[-1][1] + 2 * k:
                    spots[-1][1] = d
                else:
                    spots.append([d, d])
            for lo, hi in spots:
                a, b = max(0, lo - k), hi + len(item) + k
                if n in self.whole_words:
                    if (a == 0 or s[a - 1] == " ") and s[b:b + 1] in ("", " "):
                        found.append((0, a, b))
                    continue
                distance, end = myers(s[a:b], peq, len(item))
                if distance <= k:
                    size = myers(s[max(a, a + end - len(item) - k):a + end][::-1], back, len(item))[1]
                    found.append((distance, a + end - size, a + end))
            if found:
                distance, a, b = min(found)
                first = s.count(" ", 0, a)
                out.append({"item_id": item_id, "distance": distance, "occurrences": len(found),
                            "first_word": first, "last_word": first + s.count(" ", a, b)})
        return out


def _finder(sent, rate, piece, made={}):
    """One automaton for each worker process and broadcast."""
    if sent.value[0] not in made:
        made.clear()
        made[sent.value[0]] = Finder(sent.value[1], rate, piece)
    return made[sent.value[0]]


def _blocks(items: DataFrame, block_bytes: int):
    """Broadcasts of the items, each of a bounded size."""
    import uuid

    rows = items.where(F.length("text") > 0).select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).sort("item_id", "text").collect()
        if block:
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in block]))


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, piece: int = PIECE,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row_key and item_id, one row per document and item in it: least distance, number of
    occurrences, first and last word of the closest one in the normalised text."""
    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(sent, rate, piece)
            for batch in sliced(batches):
                ids, keys, hits = [], [], []
                for i, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                    for hit in finder.find(text):
                        ids.append(i)
                        keys.append(key)
                        hits.append(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                     *(pa.array([h[c] for h in hits], t) for c, t in
                       (("item_id", pa.int64()), ("distance", pa.int32()), ("occurrences", pa.int32()),
                        ("first_word", pa.int32()), ("last_word", pa.int32())))],
                    ["doc_id", "row_key", "item_id", "distance", "occurrences", "first_word", "last_word"])

        return run

    rows, schema = doc_rows(docs), f"doc_id long, row_key long, {HITS}"
    out = None
    for sent in _blocks(items, block_bytes):
        part = rows.mapInArrow(scan(sent), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, piece: int = PIECE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item; a filter in place, nothing is shuffled."""
    def clean(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(sent, rate, piece)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not finder.find(t or "") for t in batch.column("text").to_pylist()],
                                            pa.bool_()))

        return run

    for sent in _blocks(items, block_bytes):
        docs = docs.mapInArrow(clean(sent), docs.schema)
    return docs
