"""Sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck.functions.text import redact
from staycheck.operators.verdicts import verdict_documents


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order, personal data and credentials redacted on the way out. Ranges of the order become
    files whose names sort like the ranges, so the lines of all files in name order are in order
    (readers.numbered_lines)."""
    line = redact(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("value")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(line).write.text(path)


def write_verdicts(verdicts: DataFrame, findings: DataFrame, path: str) -> None:
    """One document per submission, redacted; the parquet tables stay the primary form."""
    docs = verdict_documents(verdicts, findings)
    docs.select(redact(F.to_json(F.struct("*"))).alias("value")).write.text(path)
