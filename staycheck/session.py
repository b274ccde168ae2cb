"""Session settings, and the shared folder jobs may cut lineage in."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **extra) -> SparkSession:
    builder = (
        SparkSession.builder.appName("staycheck")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster names; a local one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/staycheck-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table once and read it back, so several consumers share one computation and a lost
    executor costs a re-read rather than the whole lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys, three tasks to a core. For few rows that many are then made of: by their own size
    adaptive execution would merge them into one task, but it leaves a numbered repartition alone."""
    spark = df.sparkSession
    return df.repartition(min(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
