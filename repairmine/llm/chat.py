"""Chat formatting: relational formatting (operator 8).

Turns are collected as structs and sorted by (turn, role, text); adjacent
turns of one role share one block, and everything is concatenated by Spark
expressions. A block is ``<|im_start|>role\\n``, its texts with
``<|im_sep|>`` between them, and ``<|im_end|>\\n``.

Control strings begin with ``<|im_``. Inside texts and roles every ``<|``
becomes ``<||``, so none of them can hold one, and ``<||`` back to ``<|`` is
the exact inverse; in roles a backslash and a line feed become ``\\b`` and
``\\n``. ``loss_spans`` are (start, length) in code points of ``formatted``:
one for each assistant text, without its control strings.

Defined results: null text and null role are empty; null turns sort first;
rows that tie in (turn, role, text) are equal and stay apart as turns; a null
conversation id is a conversation of its own; an empty table gives no rows;
extra columns are ignored. A conversation is one row, so it must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, loss_spans``."""
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def written(x: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        head = F.when(before.isNull() | (before != x["role"]),
                      F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise("")
        tail = F.when(after.isNull() | (after != x["role"]), F.lit(END + "\n")).otherwise(SEP)
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), tail.alias("tail"),
                        (x["role"] == ASSISTANT).alias("loss"))

    parts = told.select("conv_id", F.transform("turns", written).alias("parts"))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(span), 1, 0).alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        body = F.length(p["body"]).cast("long")
        own = F.array(F.struct(start.alias("start"), body.alias("length")))
        return F.struct((start + body + F.length(p["tail"])).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("parts", state, advance)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns_of(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = unescape_role(F.substring(block, F.lit(1), line - 1))
        body = F.substring(block, line + 1, F.length(block) - line - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
