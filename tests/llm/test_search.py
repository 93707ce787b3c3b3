"""Conversation repair, lexical search and the Jaccard join against plain versions, and odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import jaccard as J
from gaugeline.llm import lexical as L
from gaugeline.llm import repair as R

BLANK = " \t\n\x0b\x0c\r"


# Jaccard join -------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows, num=80, den=100):
    sets, up = {}, {i: i for i, _ in rows}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def near_copies(seed, lengths=(3, 5, 6, 8, 9, 10, 12, 20, 40, 80, 200, 900)):
    """Copies with few words changed, dropped or added, many of them near the limit; one passage stands in a third of all texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=14)
    rows = []
    for length in lengths:
        for _ in range(4):
            base = rng.choices(vocabulary, k=length)
            if rng.random() < 0.35:
                base[len(base) // 2:len(base) // 2] = passage
            for _ in range(rng.randrange(1, 8)):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, len(copy) // 18))):
                    at, how = rng.randrange(len(copy)), rng.randrange(3)
                    copy[at:at + (how != 1)] = [] if how == 0 and len(copy) > 1 else [rng.choice(vocabulary)]
                rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_all_pairs(spark, make_docs, seed):
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect()}
    want = plain_components(rows)
    assert len(set(want.values())) < len(rows)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}


def test_join_finds_a_large_group_and_leaves_a_common_passage(spark, make_docs):
    rng = random.Random(5)
    base = [f"g{i}" for i in range(90)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(260):
        copy = list(base)
        copy[i % 90] = f"x{i}"
        rows.append((i, " ".join(copy)))
    for i in range(260, 520):  # half of the words are common to all, no two are linked
        rows.append((i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(60)])))
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(make_docs(rows)).collect()}
    assert got == plain_components(rows)


def test_join_with_odd_rows(spark, make_docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text), (2, text.upper()), (None, text), (7, None), (8, ""), (9, " \n "), (5, "a b"), (6, "A  B"), (5, text + " eleven"), (5, text + " eleven"), (11, "a b c")]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect())
    assert [g for g in got if not g[0]] == [(False, 0, 6, None)]
    by = {}
    for _, i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert by[4] == [(6, None)] and by[2] == [(6, None)] and sorted(by[5]) == [(1, None), (7, None), (7, None)]
    assert by[6] == [(1, None)] and by[11] == [(1, 11)]
    assert by[7] == [(0, 7)] and by[8] == [(0, 8)] and by[9] == [(0, 9)]
    assert J.jaccard_components(make_docs([])).count() == 0
    assert J.jaccard_components(make_docs([(1, None)])).collect()[0]["component_id"] == 1


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "b", "Gamma", "d" * 50, "é"]) for _ in range(3000)).encode()
    whole = J.shingles(text)
    monkeypatch.setattr(J, "PIECE", 37)
    assert (J.shingles(text) == whole).all() and len(J.shingles(b"x" * 500)) == 1


def odd_texts(count):
    rng = random.Random(count)
    some = [" ".join(rng.choice(["alpha", "b", "Gamma", "d" * 9, "é", f"w{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 60))).encode() for _ in range(count)]
    return [b"", b" \n", b"a b", b"A  B", b"x" * 500, b"one two three four five", *some, b" \t end ", b""]


@pytest.mark.parametrize("piece", [37, 300, 1 << 17])
def test_texts_hashed_together_give_the_sets_of_each(monkeypatch, piece):
    values = odd_texts(300)
    alone = [J.shingles(value) for value in values]
    monkeypatch.setattr(J, "PIECE", piece)
    sets = [own for some in J.shingle_sets(values, 5) for own in some]
    assert [s.tolist() for s in sets] == [s.tolist() for s in alone]
    assert [len(s) for s in sets] == [len(shingles(value.decode())) for value in values]


def test_short_texts_take_few_passes(monkeypatch):
    """One pass over the words per group of texts, not one per text."""
    values, passes, rolled = [f"word{i} and some more words of text {i}".encode() for i in range(2000)], [], J.rolled
    monkeypatch.setattr(J, "rolled", lambda *args: passes.append(1) or rolled(*args))
    assert sum(len(some.sizes) for some in J.shingle_sets(values, 5)) == 2000
    assert len(passes) < 20


@pytest.mark.parametrize("costly", [False, True])
def test_sets_cut_together_have_the_entries_of_each(costly):
    rng, bands = np.random.default_rng(3), J.Bands((80, 100))
    costs = J.Costs(rng.integers(1, 2000 if costly else 2, 1 << J.COST_BITS).astype(np.int32))
    for some in J.shingle_sets(odd_texts(200), 5):
        key, flag, owner, here = J.entries_of(some, bands, costs)
        less, less_owner = here.without_one(), np.repeat(here.sets, here.sizes)
        words, lengths = J.parity(some)
        ends = np.cumsum(lengths)
        for i, own in enumerate(some):
            alone_key, alone_flag, alone = J.entries(own, bands, costs)
            assert sorted(zip(key[owner == i].tolist(), flag[owner == i].tolist())) == sorted(zip(alone_key.tolist(), alone_flag.tolist()))
            assert less[less_owner == i].tolist() == alone.without_one().tolist()
            bits = words[ends[i] - lengths[i]:ends[i]]
            assert sum(int(w).bit_count() for w in bits) % 2 == len(own) % 2 and (len(own) > 0) == (len(bits) > 0)


@pytest.mark.parametrize("size", [4, 5, 7, 12, 30, 77, 400])
def test_the_allocation_reaches_its_weight_and_misses_no_pair(size):
    """Random sets at the limit always share a key that one of them looks up, whatever the costs say."""
    rng = np.random.default_rng(size)
    bands = J.Bands((80, 100))
    for trial in range(60):
        excess = J.Costs(rng.integers(1, 2000 if trial % 2 else 2, 1 << J.COST_BITS).astype(np.int32))
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        gone = rng.integers(0, bands.differ(size, size) + 1)
        y = x[gone:] if trial % 3 else np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, int(gone)).astype(np.uint64)]))
        same, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if not len(y) or 100 * same < 80 * union or len(x) == same == len(y):
            continue
        with np.errstate(over="ignore"):
            found = []
            for s in (x, y):
                keys, flags, parts = J.entries(s, bands, excess)
                near = parts.without_one() if parts is not None else keys[:0]
                found.append((set(keys[flags & J.PROBE > 0].tolist()), set(keys[flags & J.INDEX > 0].tolist()) | set(near.tolist())))
        assert found[0][0] & found[1][1] or found[1][0] & found[0][1]


# Lexical search -----------------------------------------------------------------------------------


def terms(text):
    out = bytearray(0 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [w for w in bytes(out).split(b"\0") if w]


def plain_search(docs, items, best):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    big_n, total = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 75 + (25 * n * big_n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_search_equals_scores_of_all_documents(spark, make_docs, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "élan", "x-y", "Z"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 90)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "-- ;"), (None, docs[3][1]), (3, docs[3][1]), (700, "w1 " * 30000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(12)] + [(20, None), (21, "!!"), (None, "w1 w1 w2"), (22, "nowhere"), (23, "W5")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.search(make_docs(docs), frame, best=7, block_words=block_words).collect()), key=str)
    assert got == plain_search(docs, items, 7)


def test_search_without_rows(spark, make_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert L.search(make_docs([(1, "a b")]), none).count() == 0
    assert L.search(make_docs([]), spark.createDataFrame([("i", "a b")], none.schema)).count() == 0


def test_words_are_whole_at_the_ends_of_pieces():
    text = b"Ab cd,efg  " + b"q" * 300 + b" h--i j" * 50
    for size in (1, 2, 3, 5, 7, 11, 64, 1000):
        assert [w for part in L.pieces(text, size) for w in part] == terms(text.decode())


# Conversation repair ------------------------------------------------------------------------------


def plain_repair(rows):
    """The cheapest edits by search over all edit sequences of one conversation; rows are (turn, role, text), present ones only."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    seen, marks = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        marks.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    roles = [r for _, _, r, _ in rows]
    following = {0: 2, 1: 2, 2: 3, 3: 2}
    memo = {}

    def best(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, letter, row, then):
            options.append((cost + then[0], letter + then[1], row + then[2]))

        if inserts < 2:
            add(5, "I", (("user" if state != 2 else "assistant", ""),), best(i, following[state], inserts + 1))
        if i < len(rows):
            add(2, "D", (), best(i + 1, state, 0))
            if marks[i] not in ("blank", "duplicate"):
                more, first = 5 if marks[i] else 0, roles[i][:1]
                if first == "s" and state == 0:
                    add(more, "K", ((roles[i], rows[i][3]),), best(i + 1, 1, 0))
                if first == ("a" if state == 2 else "u"):
                    add(more, "K", ((roles[i], rows[i][3]),), best(i + 1, following[state], 0))
                add(1 + more, "R", (("user" if state != 2 else "assistant", rows[i][3]),), best(i + 1, following[state], 0))
        memo[i, state, inserts] = min(options) if options else (10**9, "", ())
        return memo[i, state, inserts]

    cost, audit, out = best(0, 0, 0)
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, list(out)


def test_repair_equals_a_search_over_all_edits(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "open", "", " \x0b", "why? ", "Yes.", "a\nb."]
    roles = ["user", "assistant", "system", "usr", "tool", ""]
    rows, of = [], {}
    for conv in list(range(220)) + [None]:
        for _ in range(rng.randrange(0, 9)):
            row = (rng.choice([None, *range(9)]), rng.choices(roles, [8, 8, 3, 1, 2, 1])[0], rng.choice(texts + [f"t{rng.randrange(99)}." for _ in range(8)]))
            rows.append((conv, *row, "clash", 1))
            of.setdefault(conv, []).append(row)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, signature string, cost int")
    got = {}
    for r in R.repair_conversations(frame).collect():
        got[r["conv_id"]] = (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), [(x["role"], x["text"]) for x in r["repaired"]])
    assert got == {c: plain_repair(x) for c, x in of.items()}


def test_repair_of_odd_rows(spark):
    frame = "conv_id string, turn int, role string, text string, here boolean"
    rows = [("a", 0, None, "Hi.", True), ("a", 1, "assistant", None, True), ("b", 0, "user", "Gone.", False), (None, 3, "user", "Q?", True), (None, 4, "assistant", "A.", True)]
    got = {r["conv_id"]: r for r in R.repair_conversations(spark.createDataFrame(rows, frame), present="here").collect()}
    assert got["a"]["audit"] == "DD" and got["a"]["blank"] == 1 and got["a"]["illegal"] == 1 and got["a"]["cost"] == 4
    assert (got["b"]["cost"], got["b"]["audit"], got["b"]["repaired"]) == (0, "", [])
    assert got[None]["audit"] == "KK" and [tuple(x) for x in got[None]["repaired"]] == [("user", "Q?"), ("assistant", "A.")]
    assert R.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_conversation_and_a_common_signature(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(4001)] + [(c, t, r, f"{c} {t}.") for c in range(2, 900) for t, r in ((0, "user"), (1, "assistant"))]
    got = {r["conv_id"]: (r["cost"], r["audit"], len(r["repaired"])) for r in R.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.pop(1) == (2, "K" * 4000 + "D", 4000)
    assert set(got.values()) == {(0, "KK", 2)}


def test_the_automaton_is_small():
    """Whatever the signatures are, there are few nodes: costs to go differ by a bounded amount between grammar states."""
    made, rng = R.Automaton(), random.Random(2)
    for _ in range(3000):
        node = made.end
        for _ in range(rng.randrange(30)):
            node, _ = made.step(rng.choice("suaxSUAX-"), node)
    assert len(made.nodes) < 400


def test_damage_follows_the_remainder(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, 1, "assistant", "A."), (3, None, None, None)]
    got = Counter(map(tuple, R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("present").select("conv_id", "turn", "role", "text").collect()))
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            want[c, t, "user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text] += 2 if kind == 3 else 1
    assert got == want


def test_rare_shingles_find_every_link(spark, make_docs):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common[: rng.randrange(30, 60)] + [f"w{rng.randrange(12)}" for _ in range(rng.randrange(4, 25))])) for i in range(120)]
    rows += [(200 + i, " ".join(common + [f"u{i}-{k}" for k in range(8 + i % 30)])) for i in range(60)]
    sets = {i: set(J.shingles(t.encode()).tolist()) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    shaped = J.shape(make_docs(rows), "doc_id", "text")
    met = lambda comp: {(r["u"], r["v"]) for r in J.rare_pairs(shaped.selectExpr("id AS node", f"{comp} AS comp"), shaped, 5, (80, 100)).collect()}
    apart = met("id")
    assert want and want <= apart
    assert {(i, j) for i, j in want if i % 3 != j % 3} <= met("id % 3") and all(i % 3 != j % 3 for i, j in met("id % 3"))
    assert met("0L") == set()


def test_a_common_passage_makes_few_pairs(spark, make_docs, monkeypatch):
    common = " ".join(f"c{i}" for i in range(150))
    rows = [(i, f"{common} " + " ".join(f"u{i}-{k}" for k in range(60))) for i in range(150)]
    looked = []
    may_link = J.may_link
    monkeypatch.setattr(J, "may_link", lambda pairs, *rest: looked.append(pairs.count()) or may_link(pairs, *rest))
    assert all(r["component_id"] == r["doc_id"] for r in J.jaccard_components(make_docs(rows)).collect())
    assert sum(looked) < 10 * len(rows)  # not its square
