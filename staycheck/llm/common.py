"""Helpers the operators of this folder share.

Rows are told apart by (doc_id, row_key), row_key being a hash of the raw text, so rows that repeat a
doc_id with another text stay separate, and full repeats get the same decision.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycheck.session import stage

ROW_KEY = "__row_key"
SLICE_ROWS = 500


def persisted(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: one computation for several readers, and
    a lost executor costs a re-read instead of the lineage."""
    return stage(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(owner: tuple, make, memory={}):
    """What a worker process keeps from task to task, for one owner at a time: made where there is none, and
    whatever another owner had kept is given up."""
    if owner not in memory:
        memory.clear()
        memory[owner] = make()
    return memory[owner]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time, so that what a worker makes of them stays small; memory that a
    batch needed goes back before the next one. Nothing else is kept meanwhile."""
    kept((), lambda: None)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def row_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def doc_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, text) with null texts as empty ones; every other column is left behind."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text).alias("row_key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["row_key"] == right["row_key"])


def keep_rows(docs: DataFrame, kept: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs that kept (doc_id, row_key) names, with the columns of docs. once: a row that
    occurs several times stays one time."""
    left = docs.withColumn(ROW_KEY, row_key())
    right = kept.select(F.col("doc_id").alias("__kept_id"), F.col("row_key").alias("__kept_key"))
    out = left.join(right, left["doc_id"].cast("long").eqNullSafe(right["__kept_id"])
                    & (left[ROW_KEY] == right["__kept_key"]), "left_semi")
    if once:
        out = out.dropDuplicates(["doc_id", ROW_KEY])
    return out.select(*[out[f"`{c}`"] for c in docs.columns])
