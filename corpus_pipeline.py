"""The corpus pipeline: quality, near duplicates, repeated passages, leaked benchmark items, mixture.

Each stage takes the documents that its predecessor kept, as Parquet, and all but the last return the columns of documents.
The last returns one row per document with the words that the mix takes of it and the positions of its copies in training.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import held_out, table
from gaugeline.llm.decontaminate import remove_leaks
from gaugeline.llm.hyperminhash import keep_first
from gaugeline.llm.mixing import mix
from gaugeline.llm.quality import document_statistics, fit, keep_good
from gaugeline.llm.suffixes import remove_repeats
from gaugeline.session import fresh_path

NEAR = (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is 0.7 or more."""
    return keep_good(docs, fit(document_statistics(docs), table(spark, sf_dir, "labels"), ~held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: of five-word shingles four fifths or more are shared."""
    return keep_first(docs, limit=NEAR)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that also stand in a document with a smaller id; documents stay, with what is left."""
    columns = docs.columns
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"), how="documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("mixture", mixture),
]

#: A trained classifier decides in the first stage, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
