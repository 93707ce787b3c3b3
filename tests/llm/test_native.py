"""Chat formatting, decontamination and mixing: SQL text, round trips, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from gaugeline.llm.chat import format_chats, read_back
from gaugeline.llm.common import letter_words
from gaugeline.llm.decontaminate import find_leaks, remove_leaks
from gaugeline.llm.mixing import mix, place, sizes, targets
from gaugeline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, formatted string, mask int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) == ""


def chats(spark, rows):
    return format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))


def test_turns_come_back_as_they_were(spark):
    rng = random.Random(1)
    bits = ["###", "#", "\\", "</turn>", "</turn>\n", "<|next|>", ": ", "\\h", "\\b", "\n", "é", "x ", "### assistant: ", "<", "|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system: ###", "", "a\\c"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    got = {r["conv_id"]: r for r in read_back(chats(spark, rows)).collect()}
    for c in range(40):
        want = [(r, x) for cc, _, r, x in rows if cc == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want
        assert got[c]["loss_text"] == "".join(x for r, x in want if r == "assistant")


def test_adjacent_turns_share_a_block(spark):
    row = chats(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]).first()
    assert row["formatted"] == "### user: a<|next|>b</turn>\n### assistant: c</turn>\n"
    assert [tuple(m) for m in row["mask"]] == [(2, 15, 1)]


def test_odd_chat_rows(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (None, 0, "user", "y"), (2, 0, "assistant", "z" * 300_000)]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read_back(chats(spark, rows)).collect()}
    assert got[1] == [("", ""), ("assistant", ""), ("assistant", "x"), ("assistant", "x")] and got[None] == [("user", "y")] and len(got[2][0][1]) == 300_000
    assert read_back(chats(spark, rows).limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(20_000)]
    row = read_back(chats(spark, rows)).select(F.size("turns").alias("n"), F.sha2("loss_text", 256).alias("h")).first()
    assert row["n"] == 20_000 and row["h"] == hashlib.sha256("".join(x for *_, r, x in rows if r == "assistant").encode()).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_leaks(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_words(spark):
    text = "Ünï-Code_x  İĞ\tA1,b2É z"
    assert spark.createDataFrame([(text,)], "t string").select(letter_words(F.col("t"))).first()[0] == words(text)


@pytest.mark.parametrize("bound", [10**6, 0])  # broadcast and shuffled
def test_leaks_equal_plain_search(spark, make_docs, bound):
    rng = random.Random(2)
    vocabulary = ["a", "b", "É", "c1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 9, 10, 11, 14])))) for i in range(6)] + [(50, None), (9, "only here " * 6)]
    items += [(77, items[5][1])]  # a repeated item
    docs = [(i, "! ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 9, 40])))) for i in range(30)] + [(100, None), (101, ""), (102, "x " + "Only, here " * 9), (None, "y z")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_win int")
    found = find_leaks(make_docs(docs), table, broadcast_rows=bound)
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in found.collect()}
    assert got == plain_leaks(docs, items)


def test_removal_of_documents_and_spans(spark, make_docs):
    item = "one two three four five six seven eight nine ten"
    docs = make_docs([(1, f"Keep, {item}! and This."), (2, "clean text"), (3, None), (None, "clean too"), (2, "clean text")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = remove_leaks(docs, items)
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "clean too"), (2, "clean text"), (2, "clean text"), (3, "")]
    cut = remove_leaks(docs, items, how="spans")
    assert {r["text"] for r in cut.collect()} == {"Keep and This", "clean text", None, "clean too"} and cut.columns == docs.columns
    assert remove_leaks(docs.limit(0), items).count() == 0 and remove_leaks(docs, items.limit(0)).count() == 5


def plain_targets(sizes_of, weights=(1.0, 2.0, 3.0), most=3.0):
    names = sorted(sizes_of, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    done, total = {}, float(sum(sizes_of.values()))
    while True:
        free = [s for s in names if s not in done]
        level = (total - sum(done.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes_of[s]]
        if not over:
            return done | {s: weight[s] * level for s in free}
        done |= {s: most * sizes_of[s] for s in over}


def test_targets_are_filled_to_their_limits(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(i, rng.choice("abcdefg") if rng.random() < 0.9 else None, int(rng.paretovariate(0.5)) % 500) for i in range(40)]
        table = spark.createDataFrame(rows, "doc_id long, source string, size long")
        want = Counter()
        for _, s, n in rows:
            want[s] += n
        got = {r["source"]: r["target"] for r in targets(table).collect()}
        assert got == pytest.approx(plain_targets(want))


def mixture(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), "big" if i % 2 else rng.choice(["a", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "only empty"), (7, "x", "a"), (7, "x", "a")]
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, ord int")


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = mixture(spark)
    rows = mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["taken"]) for r in mix(docs.repartition(5)).collect())
    taken, target = Counter(), {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) * r["size"] == r["taken"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(rows) == 604 and all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_order_follows_the_schedules(spark):
    order = [r["source"] for r in place(mix(mixture(spark)), 1).collect()]
    assert [r["position"] for r in place(mix(mixture(spark)), 1).collect()] == sorted(r["position"] for r in place(mix(mixture(spark)), 1).collect())
    early, late = Counter(order[: len(order) // 2]), Counter(order[len(order) // 2:])
    assert early["a"] < late["a"] and early["c"] != 0  # the first source's weight rises


def test_mix_of_nothing(spark):
    docs = mixture(spark)
    assert mix(docs.limit(0)).count() == 0 and sizes(docs.where("doc_id = 900")).first()["size"] == 0
    assert [r["taken"] for r in mix(docs.where("doc_id IN (900, 901)")).collect()] == [0, 0]
