"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text). Adjacent turns of one role become one
block, `### role: text<|next|>text</turn>` and a line end: every turn is one part of the output, the first part of a block
has the block's head, the last one its end, and array functions aggregate the parts. Inside roles and texts the control
strings are escaped, so that `read_back` returns the turns as they were: `\\` becomes `\\b`, `###` `\\h`, `</turn>` `\\t`,
`<|next|>` `\\n`, and in roles `: ` becomes `\\c`.

The loss mask lists, per assistant turn, its part of the output, the start inside that part and the length, in code points.
Null texts and roles are empty; a null turn sorts first; a null conversation id is a conversation. Repeated rows stay as
turns of their own. An empty table gives no rows. A conversation is one row of the result, so it is bounded by what a row
can hold (2 GB); all steps are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, NEXT, END = "###", "<|next|>", "</turn>"
CODES = (("\\", "\\b"), (HEAD, "\\h"), (END, "\\t"), (NEXT, "\\n"))
IN_ROLES = (": ", "\\c")
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for what, code in (*CODES, *([IN_ROLES] if role else [])):
        text = F.replace(text, F.lit(what), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for what, code in (IN_ROLES, *reversed(CODES)):  # the backslash itself comes last
        text = F.replace(text, F.lit(code), F.lit(what))
    return text


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = ASSISTANT,
) -> DataFrame:
    """Per conversation: `conv_id`, `formatted`, `mask` array<struct<part, start, length>>."""
    one = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def other(x: Column, i: Column) -> Column:
        """Whether the turn at the 0-based place i is missing or has another role."""
        return F.coalesce(F.get("t", i)["role"] != x["role"], F.lit(True))

    parts = F.transform("t", lambda x, i: F.struct(
        x["role"].alias("role"),
        F.when(other(x, i - 1), F.concat(F.lit(f"{HEAD} "), escape(x["role"], True), F.lit(": "))).otherwise("").alias("head"),
        escape(x["text"]).alias("body"),
        F.when(other(x, i + 1), F.lit(f"{END}\n")).otherwise(NEXT).alias("tail"),
    ))
    mask = F.filter(
        F.transform("parts", lambda p, i: F.struct(
            i.alias("part"), F.length(p["head"]).alias("start"), F.when(p["role"] == loss_role, F.length(p["body"])).alias("length"),
        )),
        lambda m: m["length"].isNotNull(),
    )
    text_of = F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"]))
    return rows.select("conv_id", parts.alias("parts")).select("conv_id", F.array_join(text_of, "").alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """From `formatted` and `mask` alone: `conv_id`, `formatted`, `turns` array<struct<role, text>>, `loss_text`."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    skip = len(HEAD) + 2

    def read(block: Column) -> Column:
        role = F.substring_index(F.substring(block, F.lit(skip), F.length(block)), ": ", 1)
        texts = F.split(F.substring(block, F.length(role) + skip + 2, F.length(block)), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    def masked(parts: Column) -> Column:
        return F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.get(parts, m["part"]), m["start"] + 1, m["length"]))), "")

    # the parts are the variable of a lambda, so that they are split once and not once per entry of the mask
    parts = F.split("formatted", r"(?<=<\|next\|>)|(?<=</turn>\n)")
    return chats.select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, read)).alias("turns"), F.get(F.transform(F.array(parts), masked), 0).alias("loss_text"),
    )
