"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces.

A section ends at a blank line or before a heading, a paragraph is a line, and a piece is 16 to 96 code
points that end after a word with one of a few last letters, so that an edit moves the cuts near it only.
Cutting loses nothing: the pieces in order are the text. A piece's hash is that of its bytes, every other
node's that of its children's hashes, all SHA-256. Equal roots mean equal texts; `differences` goes down
the branches that differ and names the places of an edit; the likeness of two trees is the share of nodes
they have in common, counting distinct pieces and the roots (Dice), so that 1 means equal.

Only built-in functions run. Trees are nested arrays of one row; no running lists are built, so long texts
cost in proportion to their length.

`with_next` gives each document the one after it in descending order of doc_id. Rows are dealt into ranges
of doc_id with about as many bytes each, of which at most MAX_RANGES bounds pass through the driver; the
first row of each range is also sent to the range before it, so one shuffle of the texts is enough.

Cases: a null text is an empty one; its tree has no section and its root is the hash of nothing. Null doc_ids
come after all others. Rows with one doc_id follow each other in the order of a hash of their texts; full
repeats follow each other. A table of one row is followed by itself. An empty table gives an empty result.
Extra columns are left behind.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows

SPACE = r"[\x20\x09-\x0D]"
SECTION = r"(?s).+?(?:\n[\x20\x09\x0D]*\n[\x20\x09-\x0D]*|\n#{1,6}\x20|\z)"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PIECE = r"(?s).{16,96}?[.dehnrst]" + SPACE + r"+|.{1,96}"
RANGE_BYTES = 4 << 20
MAX_RANGES = 16384
LOWEST = -(1 << 63)


def _parts(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, r'{pattern}', 0)"


def tree(text: str = "text") -> Column:
    """struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, pieces: array<hash>>>>>> of
    a text that isn't null."""
    pieces = f"transform({_parts('p', PIECE)}, x -> sha2(x, 256))"
    paragraphs = f"transform(transform({_parts('s', PARAGRAPH)}, p -> {pieces}), " \
                 "h -> named_struct('hash', sha2(array_join(h, ''), 256), 'pieces', h))"
    sections = f"transform(transform({_parts(text, SECTION)}, s -> {paragraphs}), " \
               "q -> named_struct('hash', sha2(array_join(q.hash, ''), 256), 'paragraphs', q))"
    root = f"transform(array({sections}), t -> named_struct('root', sha2(array_join(t.hash, ''), 256), 'sections', t))"
    return F.expr(f"{root}[0]")


def nodes(of: str = "tree") -> Column:
    """Distinct nodes two trees are compared by, each as 60 bits of its hash: the root and the pieces."""
    pieces = f"flatten(flatten(transform({of}.sections, s -> s.paragraphs.pieces)))"
    return F.expr(f"array_distinct(transform(concat(array({of}.root), {pieces}), "
                  "h -> cast(conv(left(h, 15), 16, 10) AS bigint)))")


def likeness(left: str, right: str) -> Column:
    """Share of common nodes, 0 to 1; 1 for equal roots only."""
    return F.expr(f"2.0D * size(array_intersect({left}, {right})) / (size({left}) + size({right}))")


def with_tree(df: DataFrame, text: str = "text", named: str = "") -> DataFrame:
    """df with the columns <named>root and <named>nodes of a text."""
    grown = df.withColumn("_tree", tree(text))
    return grown.withColumns({f"{named}root": F.col("_tree.root"), f"{named}nodes": nodes("_tree")}).drop("_tree")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, tree, one row per row of docs."""
    return doc_rows(docs).select("doc_id", "row_key", tree().alias("tree"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, side ('before' or 'after'), section, paragraph, piece (numbers from 0), hash: the pieces that
    one side of a document has and the other lacks, in branches that differ. before and after: doc_id (once
    each) and tree; a document of one side only differs in all its pieces."""
    sides = [df.select("doc_id", F.lit(side).alias("side"), F.posexplode("tree.sections").alias("section", "node"))
             for side, df in (("before", before), ("after", after))]
    level = sides[0].unionByName(sides[1])
    for child, name in (("paragraphs", "paragraph"), ("pieces", "piece")):
        level = _of_one_side(level, F.col("node.hash"))
        kept = [c for c in level.columns if c != "node"]
        level = level.select(*kept, F.posexplode(f"node.{child}").alias(name, "node"))
    return _of_one_side(level, F.col("node")).withColumnRenamed("node", "hash")


def _of_one_side(rows: DataFrame, node_hash: Column) -> DataFrame:
    rows = rows.withColumn("_hash", node_hash)
    sides = rows.groupBy("doc_id", "_hash").agg(F.min("side").alias("_least"), F.max("side").alias("_most"))
    one = sides.where("_least = _most").select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_own"))
    return rows.join(one, rows["doc_id"].eqNullSafe(one["_doc"]) & (rows["_hash"] == one["_own"]), "left_semi").drop("_hash")


def _range_of(bounds: list[int]) -> Column:
    """How many bounds a row's place reaches, by halving."""
    step, steps = 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, by: F.when((at + by <= len(bounds)) & (F.try_element_at(held, at + by) <= F.col("place")), at + by).otherwise(at))


def with_next(rows: DataFrame, carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df,
              range_bytes: int = RANGE_BYTES) -> DataFrame:
    """rows (doc_id, row_key, text and others) with next_<column> for each carried column, of the row that
    follows in descending order of doc_id; the first follows the last. derive adds columns of a row itself,
    once for each row."""
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(LOWEST)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, 1 + size // range_bytes)
    bounds = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = rows.agg(F.percentile_approx("place", shares, 10 * ranges)).first()[0] or []
    rows = rows.withColumn("range", _range_of(sorted(set(bounds))))
    ends = rows.groupBy("range").agg(F.max("place").alias("place"))
    keys = rows.select("range", "place", "row_key").join(F.broadcast(ends), ["range", "place"])
    keys = keys.groupBy("range", "place").agg(F.max("row_key").alias("row_key"))  # at most one row for each range
    order = Window.orderBy("range")
    before = F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy(F.lit(0))))
    keys = keys.withColumn("before", before).drop("range")
    # the first row of a range, once, as what follows the last row of the range before it
    heads = rows.join(F.broadcast(keys), ["place", "row_key"]).dropDuplicates(["before"])
    heads = heads.withColumn("range", F.col("before")).withColumn("is_head", F.lit(True))
    every = derive(rows.withColumn("is_head", F.lit(False)).unionByName(heads.select(*rows.columns, "is_head")))
    order = Window.partitionBy("range").orderBy("is_head", F.desc("place"), F.desc("row_key"))
    out = every.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return out.where(~F.col("is_head")).drop("place", "range", "is_head")
