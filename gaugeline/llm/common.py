"""Shared column expressions: words, reading tables, row bounds."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: What separates words of letters and digits, in text that is already in lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word as anything between ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; `lower` does the same where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def letter_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_back(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels no model learns from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def free_name(columns: list[str], name: str) -> str:
    """The name, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
