"""A cleaning pipeline over ``documents``, each stage one operator of ``scriptorium.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs`` as they came.

1. language: rejects documents without a letter or without a clear language (operator 8)
2. near_duplicates: one document of each group of near copies stays (operator 6)
3. decontaminate: documents that hold a window of the benchmark go (operator 2)
4. secrets: documents with a secret go (operator 1)
5. tokenize: ids of each text that is left, and their round trip, as digests (operator 7)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, jaccard, langid, queries, secrets
from scriptorium.llm.support import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go, as they have no letter; very long ones are scored whole. Rows may repeat, and all stay or go. No rows give none."""
    return langid.kept(docs, langid.default_vocabulary())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows are copies, so one stays; texts without words, null ones too, all stay. Ids may repeat or be null."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes by its own text, so ids and other columns don't matter; null and empty texts stay."""
    return decontaminate.clean(docs, queries.read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no secret and stay. What counts is what the present rules find, whatever else the ledger knows; texts meet their findings by content, so ids may repeat or be null."""
    found = secrets.scan(docs.select(F.col("doc_id").alias("path"), "text"), queries.ledger(spark))
    return secrets.without_findings(docs, found)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, with its id as it is; a null text has no ids."""
    return queries.round_trip(docs, queries.tokenizer(spark))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("tokenize", tokenize),
]

#: Language identification has no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
