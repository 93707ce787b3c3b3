"""The limits of near copies: of the operator's query, and of the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from gaugeline.llm import hyperminhash as H
from test_dedup import shingles


def pairs():
    """Texts of n + 4 words that differ in the last: of n + 1 shingles n - 1 are shared."""
    rows = []
    for n in (8, 9, 10, 11, 12, 13, 20):
        words = [f"v{n}x{i}" for i in range(n + 4)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:-1], "last"]))]
    return rows


def test_the_stage_drops_pairs_of_four_fifths(spark, make_docs):
    rows = pairs()
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make_docs(rows), "").collect()}
    # 7/9 lies below 0.8; 8/10 to 11/13 from 0.8 to below 0.85; 12/14 and 19/21 above
    assert kept == {16, 17, 18, 20, 22, 24, 26, 40}
    of_query = {r["doc_id"] for r in H.near_duplicates(make_docs(rows), limit=(85, 100)).where("kept").collect()}
    assert of_query == {16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40}


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 400])
@pytest.mark.parametrize("limit", [(80, 100), (60, 100)])
def test_groups_follow_the_limit(spark, make_docs, chunk_bytes, limit):
    rng, rows = random.Random(8), []
    for length in (30, 60, 200):
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, length // 30))):
                copy[rng.randrange(length)] = f"z{rng.randrange(500)}"
            rows.append((len(rows), " ".join(copy)))
    sets, up = {i: shingles(t) for i, t in rows}, list(range(len(rows)))
    for a, b in [(a, b) for a in sets for b in sets if a < b]:
        if limit[1] * len(sets[a] & sets[b]) >= limit[0] * len(sets[a] | sets[b]):
            old, new = max(up[a], up[b]), min(up[a], up[b])
            up = [new if x == old else x for x in up]
    # bands of two registers meet at 0.6 as surely as those of six at 0.8
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(make_docs(rows), chunk_bytes=chunk_bytes, limit=limit, band=6 if limit[0] == 80 else 2).collect()}
    assert got == dict(enumerate(up))
