"""Language, quality, lengths, licences and neighbours: gradients, accuracy on rows left out, plain versions, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import hnsw, langid, licenses, quality
from gaugeline.llm.common import held_out, table
from gaugeline.llm.lengths import length_counts, length_table, limits_report, quantiles
from gaugeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], hidden=4, seed=3)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    rows, lengths, letters, owner = langid.pack(["ab", "éb", "xyzxyz" * 9])
    target = np.array([0, 1, 2])[owner]
    _, grads = net.gradients(rows, lengths, letters, target)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape) if name[0] != "x" else (int(rng.choice(rows[0][:4])), int(rng.integers(0, w.shape[1])))
            keep = w[at]
            w[at] = keep + 1e-3
            high = net.gradients(rows, lengths, letters, target)[0]
            w[at] = keep - 1e-3
            low = net.gradients(rows, lengths, letters, target)[0]
            w[at] = keep
            assert (high - low) / 2e-3 == pytest.approx(grads[name][at], abs=3e-3)


def test_languages_of_documents_left_out(spark):
    docs = table(spark, SF, "documents")
    right = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_odd_texts_have_a_language(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "123 !? ²"), (4, "wort " * 20_000), (5, "x" * 50_000), (None, "wort und wort"), (5, "y"), (6, "the 1")]
    trained = langid.train(make_docs([(i, "das wort und der satz") for i in range(20)], "de").union(make_docs([(i, "the word and a line") for i in range(20)])), F.lit(True))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.label_documents(make_docs(rows), trained).collect()]
    assert [(i, x) for i, x, _ in got if i in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and dict((i, x) for i, x, _ in got)[4] == "de"
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert langid.train(make_docs([]), F.lit(True)) is None
    assert [r["lang_pred"] for r in langid.label_documents(make_docs([(1, "a")]), None).collect()] == ["und"]
    assert langid.label_documents(make_docs([]), trained).count() == 0


def test_scores_of_documents_left_out(spark):
    scored = QUERIES["op7_quality"](spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id")
    rows = scored.where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_odd_rows_have_a_score(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "word " * 100_000), (None, "x"), (2, "again")])
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows, want in ((labels, None), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 1.0)):
        model = quality.fit(stats, rows, F.lit(True))
        scores = [r["score"] for r in quality.score(stats, model).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and (want is None or set(scores) == {want})
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs, model).count() == 5
    assert quality.score(quality.document_statistics(make_docs([])), model).count() == 0


def test_isotonic():
    knots, values = quality.isotonic(np.array([0.0, 0.1, 0.2, 0.3]), np.array([0.0, 3, 1, 2]), np.array([2.0, 4, 4, 2]))
    assert values.tolist() == [0.0, 0.5, 1.0] and knots == pytest.approx([0.0, 0.15, 0.3])


def test_length_table_equals_plain_counts(spark, make_docs):
    from gaugeline.llm.lengths import VOCABULARY, _encoding, _pattern

    rng = random.Random(1)
    texts = [None, "", "a"] + [" ".join(rng.choices(["word", "é", "x1", "longerword"], k=rng.randrange(30))) for _ in range(60)] + ["z " * 3000, "w" * 20_000]
    docs = make_docs(list(enumerate(texts)) + [(3, texts[3])])
    lengths = sorted(len(_encoding(VOCABULARY, _pattern()).encode_ordinary(t or "")) for t in texts + [texts[3]])
    rows = {r["n_tokens"]: r for r in length_table(length_counts(docs)).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["cut_tokens"] == sum(min(x, n) for x in lengths) and r["n_docs"] == lengths.count(n)
    made = length_table(length_counts(docs))
    for r in limits_report(made, [0, 7, 100, 10**6]).collect():
        n = r["context"]
        assert (r["fits"], r["cut_tokens"], r["lost_tokens"]) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
    assert [r["n_tokens"] for r in quantiles(made, [0.5, 1.0]).collect()] == [lengths[(len(lengths) - 1) // 2 + (len(lengths) % 2 == 0) * 0], lengths[-1]]
    assert length_table(length_counts(docs.limit(0))).count() == 0


def scan(spark, make_docs, rows, **options):
    return {r["doc_id"]: r for r in licenses.license_labels(licenses.scan_licenses(make_docs(rows), **options)).collect()}


def test_license_labels(spark, make_docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0 (the \"License\");"), (2, "Licensed under the apache\nlicense version 3.0"), (3, "CC-BY! GNU general public license. cc by"),
        (4, "It is released under the MIT License."), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction"),
        (6, None), (7, ""), (8, "licensed under a Creative Commons Attribution 4.0 International"), (9, "x " * 100_000 + "mit license " + "y " * 100_000), (10, "admit licenses"), (11, "mit licenseé"),
    ]
    got = scan(spark, make_docs, rows)
    assert [got[i]["labels"] for i in range(1, 12)] == ["apache,apache-2.0", "apache", "cc-by,gpl", "mit", "mit-text", "", "", "cc-by-4.0", "mit", "", ""]
    assert [(got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"])] == [(8, 3, 0, 6, "cc-by,gpl")]
    assert (got[9]["first_word"], got[9]["n_words"]) == (100_000, 200_002) and got[6]["n_words"] == 0 and got[7]["first_word"] is None
    assert [got[i]["score"] for i in (1, 2, 7)] == [1.0, 0.5, 0.0] and scan(spark, make_docs, []) == {}


def test_automaton_needs_its_mandatory_words():
    a = licenses.Automaton("grant to [[all the]] users {{2}} of {{this|that}} work")
    ends = lambda text: a.longest(licenses.words_of(text.encode()), 0)
    assert ends("Grant to users of this work") == 6 and ends("grant to all the users of that work now") == 8 and ends("grant to users x y of this work") == 8
    assert ends("grant to users x y z of this work") == -1 and ends("grant to all users of this work") == -1 and ends("grant to users of a work") == -1


def nearest(spark, rows, k=5, **options):
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    index = hnsw.build_index(table, keep=k + 1, **options)
    asked = hnsw.nodes(table, 1 << 30).select(F.explode("ids").alias("query_id"), "vector")
    out = {}
    for r in hnsw.search_index(index, asked, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    got = nearest(spark, [(i, v.tolist()) for i, v in enumerate(x)], shard_size=500)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, 1)[:, :5]
    recall = np.mean([len({i for i, _ in got[q]} & set(want[q].tolist())) / 5 for q in range(1500)])
    assert recall >= 0.95 and all(abs(s - sims[q, i]) < 1e-9 for q in range(0, 1500, 50) for i, s in got[q])


def test_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [None, 1.0]), (54, [float("inf"), 1.0]), (55, []), (56, [0.0, 1.0]), (57, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0])]
    got = nearest(spark, rows)
    assert set(got) == {*range(40), 56} and [i for i, _ in got[2]] == [0, 1, 3, 4, 5] and [i for i, _ in got[56]] == [0, 1, 2, 3, 4]
    assert nearest(spark, []) == {}


def test_training_never_sees_what_is_held_out(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
