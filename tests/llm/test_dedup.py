"""Near duplicates and repeated passages against plain versions, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from gaugeline.llm import hyperminhash as H
from gaugeline.llm import suffixes as X
from gaugeline.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(400, 400)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def shingles(text):
    w = (text or "").encode().lower().split() if (text or "").isascii() else (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets, up = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for length in (3, 6, 7, 8, 12, 20, 40, 80, 200, 600):
        for _ in range(3):
            base = rng.choices(vocabulary, k=length)
            for _ in range(rng.randrange(1, 9)):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, length // 12))):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                rows.append((n, "  ".join(copy)))
                n += 1
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 400])  # whole groups, and groups in pairs of chunks
def test_near_duplicates_equal_plain_search(spark, make_docs, chunk_bytes):
    rows = near_copies(4)
    rows += [(1000, "Same Words Here Now Again And"), (1001, "same words\there now\nagain and"), (1002, ""), (1003, None), (1004, "   "), (1005, "one"), (1006, "ONE"), (1007, "É one two three"), (1008, "é one two three")]
    got = {r["doc_id"]: r for r in H.near_duplicates(make_docs(rows), chunk_bytes=chunk_bytes).collect()}
    want = plain_groups(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[i])) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_repeated_ids_with_several_texts(spark, make_docs):
    # 2 is tied to 1 by a copy and to 3 by a near copy; its blank text is linked with nothing
    near = "p q r s t u v w x y z a b c d e f g h i j k l m n o"
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, near + " one"), (2, " "), (3, near + " two"), (3, ""), (4, ""), (4, "z")]
    assert {(r["doc_id"], r["component_id"]) for r in H.near_duplicates(make_docs(rows)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_many_copies_and_repeated_ids(spark, make_docs):
    rows = [(i, "a b c d e f g") for i in range(300)] + [(5, "p q r s t u v"), (900, "p q r s t u v"), (None, "a b c d e f g"), (None, "z")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in H.near_duplicates(make_docs(rows)).collect()]
    assert len(got) == 304 and {c for _, c, _ in got} == {None} and sum(k for *_, k in got) == 2
    assert H.keep_first(make_docs(rows)).count() == 2
    assert H.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_kept_rows_keep_their_columns(spark, make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")])
    left = H.keep_first(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_estimates_lie_near_the_truth():
    rng = np.random.default_rng(1)
    for n, m, shared in ((3000, 3000, 2600), (900, 1000, 850), (5000, 5000, 0), (40_000, 30_000, 20_000)):
        pool = rng.integers(1, 2**63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n:n + m - shared]])
        guess, _ = H.similarity(H.registers(a), H.registers(b)[None], n, np.array([m]))
        assert abs(guess[0] - shared / (n + m - shared)) < 0.12


def test_registers_hold_zeros_and_mantissa():
    values = np.array([(1 << 55) << 8, (1 << 54 | 1 << 53) << 8 | 1, 1 << 8 | 2], np.uint64)
    regs = H.registers(values)
    assert [int(r) for r in regs[:3]] == [0 << 10 | 0, 1 << 10 | 512, 55 << 10 | 0] and (regs[3:] == 65535).all()
    assert (H.dense(regs[None])[0] != 65535).all() and (H.dense(regs[None])[0][:3] == regs[:3]).all()


def plain_cut(rows, length=50):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = min(seen.get(b[k:k + length], i), i)
    for n, (i, t) in enumerate(rows):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] < i:
                gone |= set(range(k, k + length))
        runs = sum(1 for x in gone if x - 1 not in gone)
        out[n] = (i, len(b), len(gone), runs, hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest())
    return sorted(out.values())


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("ab cé", k=n))
    shared = [text(n) for n in (49, 50, 51, 90, 300)]
    rows = [(i, text(rng.randrange(0, 200)) + rng.choice(shared) + text(rng.randrange(0, 40)) + (rng.choice(shared) if rng.random() < 0.5 else "")) for i in range(60)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, rows[3][1] + "x"), (73, None), (74, ""), (75, "x" * 49), (76, "x" * 400), (77, "y" + "x" * 120), (78, "\x00" * 60), (79, "a" + "\x00" * 55), (80, "x" * 49)]
    return rows


def digest(cut):
    return sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["text"]).hexdigest()) for r in cut.collect())


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_cut_equals_plain_search(spark, make_docs, monkeypatch, piece):
    rows = passages(1)
    monkeypatch.setattr(X, "PIECE", piece)
    assert digest(X.remove_repeats(make_docs(rows).select("doc_id", "text"), as_text=False, chunk_bytes=2000)) == plain_cut(rows)


@pytest.mark.parametrize("piece", [40, 64, 1000])
def test_anchors_do_not_depend_on_pieces(monkeypatch, piece):
    data = np.frombuffer(bytes(random.Random(2).choices(b"abc", k=3000)), np.uint8)
    for n in (50, 51, 100, 3000):
        whole = X.anchors(data[:n])
        monkeypatch.setattr(X, "PIECE", piece)
        parts = X.anchors(data[:n])
        monkeypatch.undo()
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
        covered = whole[0][:, None] - np.arange(35)[None]
        assert set(range(n - 49)) <= set(covered.ravel().tolist())


def test_multikey_order():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    assert (keys[X.multikey_order(keys)] == keys[np.lexsort(keys.T[::-1])]).all() and len(X.multikey_order(keys[:0])) == 0


def test_cut_texts_stay_texts(spark, make_docs):
    a, b = "é" * 40 + "start", "à" * 1 + "é" * 40 + "end"  # the copies begin in the middle of a character
    docs = make_docs([(1, a), (2, b), (2, b), (None, "z" * 60), (3, "q" + "z" * 60)])
    cut = X.remove_repeats(docs)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in cut.collect())
    assert cut.columns == [*docs.columns, "n_bytes", "removed"]
    assert got == [(0, "z" * 60), (1, a), (2, "àend"), (2, "àend"), (3, "q")]
    assert X.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_cut_by_their_own_texts(spark, make_docs):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    copy, passage = text(120), text(70)
    rows = [(1, copy), (2, copy), (2, text(130)), (3, text(20) + passage), (4, text(60) + passage + text(30)), (4, text(200)), (4, text(90)), (4, passage + "z")]
    rows += [(None, text(80) + passage), (None, text(150)), (2, copy), (2, "short")]
    key = [(-1 if i is None else i, t) for i, t in rows]
    got = digest(X.remove_repeats(make_docs(key).select("doc_id", "text"), as_text=False))
    assert got == plain_cut(key)
    cut = {(r["doc_id"], r["n_bytes"], len(r["removed"])) for r in X.remove_repeats(make_docs(rows)).collect()}
    assert {(2, 120, 1), (2, 130, 0), (4, 200, 0), (4, 90, 0), (4, 160, 1), (4, 71, 1), (3, 90, 1), (1, 120, 0), (None, 150, 0), (None, 150, 0)} <= cut
