"""The corpus pipeline: documents to token ids.

Documents whose language is rejected go; of exact copies the largest doc_id stays, of near copies the
smallest; documents that hold a benchmark item go; what is left is encoded and decoded again. The stages
before the last return rows of documents as they came. Stages hand on written tables.
"""

from pyspark.sql import DataFrame, SparkSession

from staycheck.llm import decontaminate, exact_dedup, language_id, simhash
from staycheck.llm.common import persisted, table
from staycheck.llm.queries import learns_language, round_trip, vocabulary


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_rejected(docs, language_id.fit(docs, learns_language()))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, *vocabulary())


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_exact_copies),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
