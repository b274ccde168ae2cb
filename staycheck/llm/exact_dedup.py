"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered; then
adjacent numbers are paired, distinct pairs sorted and numbered, and so on until each document has
one number. Two documents have the same (number of blocks, number) exactly if their texts are equal:
blocks are compared by content, a hash only routes them.

Cases: null text is an empty text; an empty text is one empty block. Equal texts with equal doc_id
(repeated rows) count as separate members of their group. A null doc_id never wins over another; a
group of null ids only keeps them. An empty table gives an empty result. Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows, keep_rows, persisted, same_row, sliced

BLOCK_BYTES = 8192
BLOCKS = "doc_id long, row_key long, sha binary, blocks int, pos int, h long"


def _cut(block_bytes: int, hash_bits: int, content: bool):
    """Batches of documents to batches of blocks of the text with A-Z lower-cased."""
    import xxhash

    shift = 64 - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, keys, shas, counts, places, hashes, parts = ([] for _ in range(7))
            texts = pc.ascii_lower(batch.column("text"))
            for i, key, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("row_key").to_pylist(), texts):
                data = text.as_buffer().to_pybytes()
                sha = hashlib.sha256(data).digest()
                n = max(1, -(-len(data) // block_bytes))
                for p in range(n):
                    part = data[p * block_bytes:(p + 1) * block_bytes]
                    ids.append(i)
                    keys.append(key)
                    shas.append(sha)
                    counts.append(n)
                    places.append(p)
                    hashes.append((xxhash.xxh64_intdigest(part) >> shift) - (1 << (hash_bits - 1)))
                    if content:
                        parts.append(part)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                       pa.array(shas, pa.binary()), pa.array(counts, pa.int32()),
                       pa.array(places, pa.int32()), pa.array(hashes, pa.int64())]
            names = ["doc_id", "row_key", "sha", "blocks", "pos", "h"]
            if content:
                columns.append(pa.array(parts, pa.binary()))
                names.append("block")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def name_blocks(blocks: DataFrame) -> DataFrame:
    """(h, name, block): integer names of the distinct blocks, in the order of a sort by content.
    block is filled only where several contents share a hash, where it is needed to tell them apart.

    The set per hash is combined before the shuffle and holds one block, or the few that collide; a
    block that a third of all documents share is one row of each map task."""
    sets = blocks.groupBy("h").agg(F.collect_set("block").alias("found"))
    rows = sets.select("h", (F.size("found") > 1).alias("shared"), F.explode("found").alias("block"))
    named = rows.sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id())
    return named.select("h", "name", F.when(F.col("shared"), F.col("block")).alias("block"))


def name_pairs(pairs: DataFrame) -> DataFrame:
    """(left, right, name): integer names of the distinct pairs, sorted."""
    distinct = pairs.select("left", "right").distinct()
    return distinct.sortWithinPartitions("left", "right").withColumn(
        "name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, row_key, sha (of the normalised text), blocks, name. Equal
    (blocks, name) means equal texts. hash_bits only routes; fewer bits give the same groups."""
    rows = doc_rows(docs)
    placed = persisted(rows.mapInArrow(_cut(block_bytes, hash_bits, False), BLOCKS))
    contents = rows.mapInArrow(_cut(block_bytes, hash_bits, True), BLOCKS + ", block binary")
    names = persisted(name_blocks(contents))
    plain = names.where(F.col("block").isNull()).select("h", "name")
    named = placed.join(plain, "h")
    shared = names.where(F.col("block").isNotNull())
    if not shared.isEmpty():
        named = named.unionByName(contents.join(shared, ["h", "block"]).drop("block"))
    named = persisted(named.drop("h"))
    one = named.where("blocks = 1").select("doc_id", "row_key", "sha", "blocks", "name")
    rest, width = named.where("blocks > 1"), placed.agg(F.max("blocks")).first()[0] or 1
    while width > 1:
        pairs = persisted(rest.groupBy(
            "doc_id", "row_key", "sha", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")
        ).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        rest = persisted(pairs.join(persisted(name_pairs(pairs)), ["left", "right"])
                         .drop("left", "right"))
        width = -(-width // 2)
    # full repeats of a long row were paired as one; each of them takes its identity back
    rows = placed.where("pos = 0 AND blocks > 1").select("doc_id", "row_key")
    last = rest.where("pos = 0")
    return one.unionByName(rows.join(last, same_row(rows, last)).select(
        rows["doc_id"], rows["row_key"], "sha", "blocks", "name"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, row_key, keep_id, group_size, kept, text_sha256, one row per row of docs; of equal
    texts the largest doc_id stays."""
    ids = persisted(identities(docs, block_bytes, hash_bits))
    # written before the join, which then deals both sides out itself and can split a large group
    groups = persisted(ids.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"),
                                                         F.count(F.lit(1)).alias("group_size")))
    return ids.join(groups, ["blocks", "name"]).select(
        "doc_id", "row_key", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without copies: the row with the largest doc_id of each group, once."""
    return keep_rows(docs, exact_dedup(docs, **options).where("kept"), once=True)
