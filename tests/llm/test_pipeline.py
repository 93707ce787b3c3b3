"""The pipeline against plain versions of its stages on one small table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gaugeline.llm.queries import QUERIES
from test_dedup import plain_cut, plain_groups
from test_native import plain_leaks


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "erat", "nulla", "vitae", "justo", "quis", "nunc"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    item = prose(14)
    rows, labels = [], []
    for i in range(120):
        text = prose(rng.randrange(30, 120))
        if i % 10 == 3:
            text = " ".join(w + "$$$" for w in text.upper().split())
            labels.append((i, 0, 0))
        else:
            labels.append((i, 1, 0))
        if i % 10 == 5:
            text = rows[i - 1][1].replace("nunc.", "quis.")
        if i % 10 == 7:
            text += " " + item + " " + prose(20)
        if i % 10 == 8:
            text = prose(40) + " " + rows[i - 2][1][:200] + " " + prose(30)
        rows.append((i, text))
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        assert name == "mixture" or docs.columns == before.columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i: t for i, t in rows if i % 10 != 3}
    assert {i: r["text"] for i, r in seen["quality"].items()} == good
    groups = plain_groups(list(good.items()))
    assert set(seen["near_dedup"]) == {i for i in good if groups[i] == i}
    plain = {i: n for i, _, n, _, _ in plain_cut(sorted((i, good[i]) for i in seen["near_dedup"]))}
    cut = {i: len(good[i]) - len(r["text"]) for i, r in seen["suffix_dedup"].items()}
    assert cut == plain and all(r["n_chars"] == len(r["text"]) for r in seen["suffix_dedup"].values())
    leaks = plain_leaks([(i, r["text"]) for i, r in seen["suffix_dedup"].items()], [(1, item)])
    assert set(seen["decontaminate"]) == {i for i, (_, hit, _) in leaks.items() if not hit}
    assert {i: r["size"] for i, r in seen["mixture"].items()} == {i: len(r["text"].split()) for i, r in seen["decontaminate"].items()}
    whole = {r["doc_id"]: r["taken"] for r in QUERIES["pipeline"](spark, sf).collect()}
    assert whole == {i: r["taken"] for i, r in seen["mixture"].items()}


def test_stages_take_odd_and_no_rows(spark, tmp_path):
    sf, kinds = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "s", 0), (2, "x", "en", None, 1), (2, "x", "en", None, 1), (3, "word " * 30_000, "en", "s", 5)], kinds)
    for docs, n in ((odd, 5), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).persist()
            assert docs.count() == n
    assert F is not None
