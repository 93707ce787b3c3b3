"""Columns of the documents may have any names."""

import pytest
from pyspark.sql import functions as F

from gaugeline.llm.decontaminate import remove_leaks
from gaugeline.llm.hyperminhash import keep_first

TEXT = "one two three four five six seven eight nine ten eleven"


def odd(docs, names):
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    return docs


def test_near_copies_beside_a_column_of_the_same_name(make_docs):
    docs = odd(make_docs([(2, TEXT), (1, TEXT), (3, "else entirely")]), ["gone_id", "GONE_ID_", "component_id", "kept"])
    got = {r["doc_id"]: r["gone_id"] for r in keep_first(docs).collect()}
    assert got == {1: "own gone_id", 3: "own gone_id"} and keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("how, want", [("documents", {2: "clean"}), ("spans", {1: "before after", 2: "clean"})])
def test_leaks_beside_columns_of_the_same_names(spark, make_docs, how, want):
    docs = odd(make_docs([(1, f"before {TEXT} after"), (2, "clean")]), ["leak_id", "leak_key", "leak_spans", "spans", "items"])
    left = remove_leaks(docs, spark.createDataFrame([(7, TEXT)], "item_id long, text string"), how)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want and left.columns == docs.columns
    assert all(r["leak_spans"] == "own leak_spans" for r in left.collect())
