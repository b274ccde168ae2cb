"""SimHash near-dedup with deletion-variant signatures.

A fingerprint's 64 bits are cut into two segments of 32. Of two fingerprints that differ in at most
two bits, one segment differs in at most one; so both own a signature in common if every segment is
indexed with each of its bits left out. Signatures meet by equality, and the distance is verified.

Signatures that more than `crowd` different fingerprints share are not paired. Their members are
indexed again with two bits left out of all 64 (one in each segment, or two in the other segment).
At most four fingerprints share such an index entry and all of them are within two bits, so it links
them without comparing, and no group is ever expanded into its pairs.

Cases: null text is an empty text; texts without words have fingerprint zero and link like any other.
Rows that repeat a doc_id are fingerprinted separately. A null doc_id names a component only if all
of its ids are null. An empty table gives an empty result. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, keep_rows, persisted, sliced
from staycheck.llm.graph import components

SHINGLE = 3
SEED = 42
CROWD = 256
CHUNK = 1 << 15
LOW32 = 0xFFFFFFFF


def fingerprint(data: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes, most significant first, of a lower-cased text in UTF-8."""
    import xxhash

    words = data.split()  # of bytes: exactly space and \\x09 to \\x0d
    if not words:
        return bytes(8)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    starts = ends - sizes
    span = min(shingle, len(words))
    first, last = starts[:len(words) - span + 1], ends[span - 1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in
                        zip(first[at:at + CHUNK].tolist(), last[at:at + CHUNK].tolist())])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255  # sums of 255 rows fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(first)).tobytes()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pc.ascii_lower(batch.column("text"))
            prints = [int.from_bytes(fingerprint(t.as_buffer().to_pybytes(), shingle), "big", signed=True)
                      for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(prints, pa.int64())],
                ["doc_id", "row_key", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return doc_rows(docs).mapInArrow(_fingerprints(shingle), "doc_id long, row_key long, print long")


def signatures(prints: DataFrame) -> DataFrame:
    """64 rows per fingerprint: one segment without one of its bits. v // 32 is the segment, v % 32
    the bit left out."""
    return prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        "print", "v", F.expr(f"shiftleft(cast(v AS bigint), 32) | (shiftrightunsigned(print, (v div 32) * 32)"
                             f" & {LOW32} & ~shiftleft(1L, v % 32))").alias("signature"))


def _close(a: str, b: str, v: str) -> str:
    """At most two bits apart; a pair with an equal segment counts where bit 0 is left out only."""
    segment = f"(shiftrightunsigned({a} ^ {b}, cast(({v} div 32) * 32 AS int)) & {LOW32})"
    return f"bit_count({a} ^ {b}) <= 2 AND ({segment} <> 0 OR {v} % 32 = 0)"


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) of different fingerprints: enough of the pairs within two bits to connect all of them.
    prints: distinct values in a column `print`."""
    signed = signatures(prints)
    met = persisted(signed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
        .where("n > 1").withColumn("v", F.shiftright("signature", 32).cast("int")))
    twos = met.where(f"n = 2 AND {_close('a', 'b', 'v')}").select("a", "b")
    # sorted and merged at every size: broadcast, the shared signatures would grow with the corpus
    members = persisted(signed.drop("v").join(met.where("n > 2").select("signature", "n", "v").hint("merge"), "signature"))
    few = members.where(F.col("n") <= crowd)
    pairs = few.select("signature", "v", F.col("print").alias("a")).join(
        few.select("signature", F.col("print").alias("b")), "signature").where(
        f"a < b AND {_close('a', 'b', 'v')}").select("a", "b")
    # bit numbers in the whole fingerprint: the segment's own bit and one of the other segment, or,
    # once for each segment, two of the other segment
    many = members.where(F.col("n") > crowd).select("print", "v")
    other = "explode(sequence(32 - (v div 32) * 32, 63 - (v div 32) * 32))"
    across = many.select("print", F.col("v").alias("j"), F.expr(other).alias("k"))
    within = many.where("v % 32 = 0").select("print", F.expr(other).alias("j"), "v").select(
        "print", "j", F.expr(other).alias("k")).where("j < k")
    cut = across.unionAll(within).select("print", F.least("j", "k").alias("j"), F.greatest("j", "k").alias("k"))
    stars = cut.groupBy("j", "k", F.expr("print & ~(shiftleft(1L, j) | shiftleft(1L, k))").alias("rest")).agg(
        F.min("print").alias("a"), F.collect_set("print").alias("all")).where(F.size("all") > 1).select(
        "a", F.explode("all").alias("b")).where("a <> b")
    return twos.unionAll(pairs).unionAll(stars)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits), component_id (smallest doc_id reachable over
    links of at most two bits), one row per row of docs."""
    rows = persisted(fingerprints(docs, shingle))
    nodes = persisted(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("print"), crowd))
    placed = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select(
        "doc_id", "row_key", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies: the smallest doc_id of each component stays."""
    return keep_rows(docs, near_dedup(docs, **options).where("doc_id <=> component_id"), once=True)
