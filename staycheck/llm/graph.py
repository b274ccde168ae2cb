"""Connected components by alternating large-star and small-star rounds, each round one written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import persisted


def _ordered(pairs: DataFrame) -> DataFrame:
    """Undirected pairs as (lo, hi), without loops and repeats."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("lo"),
                                        F.greatest("a", "b").alias("hi")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("a"),
                                                                F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its smaller neighbours to the others and itself."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    met = edges.join(least, "hi")
    return _ordered(met.select(F.col("lo").alias("a"), F.col("m").alias("b")).unionAll(
        least.select(F.col("hi").alias("a"), F.col("m").alias("b"))))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that isn't its component's smallest node.

    The rounds stop when the edges no longer change, which is when each node has one edge, to the
    smallest node it can reach. An edge table without rows gives no rows."""
    edges = persisted(_ordered(links))
    before = _state(edges)
    while before[0]:
        edges = persisted(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
