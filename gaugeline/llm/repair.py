"""Conversation structure repair: the cheapest edits that give roles `(system? (user assistant)+)?`.

A conversation becomes a signature, one letter per row in order: `s`, `u`, `a`, `x` (any other role), in upper case if the
row is truncated, and `-` for a row that must go. The signatures of all conversations are sorted from their ends and dealt in
ranges, so that signatures with a common suffix are neighbours: along the sorted order a stack holds the nodes of the present
suffixes, and each new suffix adds one node to the stack and no more. Nodes are minimised: two suffixes whose costs to go
differ by the same amount in every grammar state and whose best edits are equal are one node of the automaton, and what a
letter in front of a node leads to is computed once. A node holds, for each grammar state, the cost to go and the first edit
of the best audit suffix; reading the edits from the front of a signature gives the audit.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert an empty user or
assistant row 5; a truncated row that stays adds 5. Of the cheapest, the audit whose letters D, I, K, R come first in ASCII.

Rows stand by turn (nulls first), then role, then text. A null role or text is one blank, so a null text is a blank row and a
null role can only be replaced or deleted. Rows that repeat a role and text of their conversation are duplicates. A null
conversation id is a conversation. A conversation without rows has zeros and an empty audit. Extra columns do not matter; an
empty table gives no rows. A conversation is one row of the result, so it is bounded by what a row can hold (2 GB); all steps
are linear in its length, and the automaton itself does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: The state after each grammar state's required role: start, system seen, user seen, assistant seen.
FOLLOWS = (2, 2, 3, 2)
USER, ASSISTANT = "user", "assistant"


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with known faults, for tests: by crc32(conv:turn) mod 20 a row is dropped, emptied, left without sentence ends, repeated or given to the user.

    Dropped rows stay with `present` false, so that their conversation is not lost.
    """
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("kind"),
    )
    text_ = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_ = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    hurt = rows.select("conv_id", "turn", role_.alias("role"), text_.alias("text"), "kind", (F.col("kind") != 0).alias("present"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", "role", "text", "present", twice.alias("copy")).drop("copy")


def signed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """Per conversation: its rows in order (`t`), what is wrong with them, and the signature."""
    blank = F.lit(" ")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"),
    )
    earlier = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = rows.repartition("conv_id").withColumn("again", F.row_number().over(earlier) > 1)
    one = F.when(F.col("present"), F.struct("turn", "role", "text", "again"))
    packed = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))

    ends = lambda t: F.rtrim(t["text"], F.lit(BLANKS))
    initial = lambda t: F.substring(t["role"], 1, 1)

    def fault(t: Column) -> Column:
        end = ends(t)
        return F.when(end == "", "blank").when(t["again"], "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")

    def letter(role: Column, what: Column) -> Column:
        known = F.when(role.isin("s", "u", "a"), role).otherwise("x")
        return F.when(what.isin("blank", "duplicate"), "-").when(what == "truncated", F.upper(known)).otherwise(known)

    marked = packed.withColumn("f", F.transform("t", fault)).withColumn("i", F.transform("t", initial))
    numbers = F.filter(F.transform("t", lambda t: t["turn"]), lambda n: n.isNotNull())
    pairs = F.zip_with(F.slice("i", 1, F.greatest(F.size("i") - 1, F.lit(0))), F.slice("i", 2, F.greatest(F.size("i") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    count = lambda what: F.size(F.filter("f", lambda f: f == what)).cast("long")
    return marked.withColumn("n", numbers).select(
        "conv_id", "t",
        F.when(F.size("n") > 0, F.array_max("n") - F.array_min("n") + 1 - F.size(F.array_distinct("n"))).otherwise(0).cast("long").alias("gaps"),
        count("blank").alias("blank"), count("duplicate").alias("duplicate"), count("truncated").alias("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.array_join(F.zip_with("i", "f", letter), "").alias("signature"),
    )


class Automaton:
    """Minimised suffix nodes: per grammar state, cost to go above the node's least and the first edit.

    `step(letter, node)` gives the node of the suffix with the letter in front, and what the least cost rises by.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[tuple[int, ...], str]] = []
        self.known: dict[tuple[tuple[int, ...], str], int] = {}
        self.steps: dict[tuple[str, int], tuple[int, int]] = {}
        # nothing is left: start and after an assistant all is well, else the missing rows are inserted
        self.end = self._node((0, 2 * INSERT, INSERT, 0), ".II.")

    def _node(self, costs: tuple[int, ...], edits: str) -> int:
        if (costs, edits) not in self.known:
            self.known[costs, edits] = len(self.nodes)
            self.nodes.append((costs, edits))
        return self.known[costs, edits]

    def after(self, letter: str, state: int) -> int | None:
        """Where keeping the letter leads, if the grammar allows it."""
        role = letter.lower()
        if role == "s":
            return 1 if state == 0 else None
        return FOLLOWS[state] if role == ("a" if state == 2 else "u") else None

    def step(self, letter: str, node: int) -> tuple[int, int]:
        if (letter, node) not in self.steps:
            later, best = self.nodes[node][0], []
            for state in range(4):
                choices = [(later[state] + DELETE, "D")]
                if letter != "-":
                    stays = TRUNCATED if letter.isupper() else 0
                    kept = self.after(letter, state)
                    if kept is not None:
                        choices.append((later[kept] + stays, "K"))
                    choices.append((later[FOLLOWS[state]] + REROLE + stays, "R"))
                best.append(min(choices))
            two, three = best[2], best[3]
            best[2], best[3] = min(two, (three[0] + INSERT, "I")), min(three, (two[0] + INSERT, "I"))
            best[0], best[1] = min(best[0], (best[2][0] + INSERT, "I")), min(best[1], (best[2][0] + INSERT, "I"))
            least = min(c for c, _ in best)
            self.steps[letter, node] = self._node(tuple(c - least for c, _ in best), "".join(e for _, e in best)), least
        return self.steps[letter, node]

    def read(self, signature: str, nodes: list[int]) -> tuple[str, list[int], list[str | None]]:
        """Edits from the front; `nodes[k]` is the node of the last k letters. Also the rows that result: place (-1: new) and new role."""
        state, i, n, audit, places, roles = 0, 0, len(signature), [], [], []
        while True:
            edit = self.nodes[nodes[n - i]][1][state]
            if edit == ".":
                return "".join(audit), places, roles
            audit.append(edit)
            if edit != "D":
                places.append(-1 if edit == "I" else i)
                roles.append(None if edit == "K" else ASSISTANT if state == 2 else USER)
                state = self.after(signature[i], state) if edit == "K" else FOLLOWS[state]
            i += edit != "I"


OUT = "array<struct<place: int, role: string>>"


def repairs(conversations: DataFrame) -> DataFrame:
    """From `conv_id` and `signature`: `conv_id`, `cost`, `audit`, `rows` (what stays, by place, and what is new)."""
    backwards = F.reverse("signature")
    # the id as a second key splits signatures that very many conversations share
    dealt = conversations.select("conv_id", "signature").repartitionByRange(backwards, "conv_id").sortWithinPartitions(backwards)
    kind = dealt.schema["conv_id"].dataType.simpleString()
    shape = pa.struct([("place", pa.int32()), ("role", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        nodes, costs, before, answer = [automaton.end], [0], "", None
        for batch in batches:
            audits, totals, rows = [], [], []
            for signature in batch.column(1).to_pylist():
                if answer is None or signature != before:
                    n, m, shared = len(signature), len(before), 0
                    while shared < min(n, m) and signature[n - 1 - shared] == before[m - 1 - shared]:
                        shared += 1
                    del nodes[shared + 1:], costs[shared + 1:]
                    for letter in reversed(signature[:n - shared]):
                        node, more = automaton.step(letter, nodes[-1])
                        nodes.append(node)
                        costs.append(costs[-1] + more)
                    audit, places, roles = automaton.read(signature, nodes)
                    out = [{"place": p, "role": r} for p, r in zip(places, roles)]
                    before, answer = signature, (costs[n] + automaton.nodes[nodes[n]][0][0], audit, out)
                totals.append(answer[0])
                audits.append(answer[1])
                rows.append(answer[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(audits, pa.string()), pa.array(rows, pa.list_(shape))], ["conv_id", "cost", "audit", "rows"]
            )

    return dealt.mapInArrow(walk, f"conv_id {kind}, cost long, audit string, rows {OUT}")


def repair_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Per conversation: `conv_id`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`, `repaired` array<struct<role, text>>."""
    told = cut_lineage(signed(turns, **columns))
    fixed = repairs(told).withColumnRenamed("conv_id", "fixed_id")
    row = F.transform("rows", lambda r: F.struct(
        F.coalesce(r["role"], F.get("t", r["place"])["role"]).alias("role"),
        F.when(r["place"] < 0, "").otherwise(F.get("t", r["place"])["text"]).alias("text"),
    ))
    return told.join(fixed, F.col("conv_id").eqNullSafe(F.col("fixed_id"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", row.alias("repaired")
    )
