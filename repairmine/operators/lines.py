"""Line and section operators.

Reference lines are lines such as ``#include <x>`` / ``#include "x"``; the
pattern is a parameter. Per-text work is array work on the text's own row,
running state over its lines (sections) included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairmine.functions.clean import py_strip
from repairmine.operators.tokens import as_lists, in_runs, list_rows

# Fixed patterns: reference line (matched at the line start) and its name.
RX_REF_LINE = '(?s)^(?:#include *<(.*)>|#include *"(.*)")'
RX_REF_NAME_ANGLE = "(?s)^#include *<(.*)>"
RX_REF_NAME_QUOTE = '(?s)^#include *"(.*)"'
# Fixed pattern: line marker ``# n "file" flags``.
RX_MARKER = '(?s)^# ([0-9]+) "(.+)"( [1-4])*'


def lines_of(c: Column) -> Column:
    """Split like Python ``str.split('\\n')`` (trailing empty lines kept)."""
    return F.split(c, "\n", -1)


def is_ref_line(line: Column, rx: str = RX_REF_LINE) -> Column:
    return line.rlike(rx)


def ref_lines(c: Column, rx: str = RX_REF_LINE) -> Column:
    """L1: stripped lines that match the reference pattern, in order."""
    return F.filter(F.transform(lines_of(c), py_strip), lambda l: is_ref_line(l, rx))


def ref_name(line: Column) -> Column:
    """Name inside one reference line (angle form first)."""
    s = py_strip(line)
    return (F.when(s.rlike(RX_REF_NAME_ANGLE), F.regexp_extract(s, RX_REF_NAME_ANGLE, 1))
            .when(s.rlike(RX_REF_NAME_QUOTE), F.regexp_extract(s, RX_REF_NAME_QUOTE, 1)))


def ref_names(c: Column) -> Column:
    """L2: names in the reference lines, in order."""
    return F.transform(ref_lines(c), ref_name)


def drop_ref_lines(c: Column, rx: str = RX_REF_LINE) -> Column:
    """L3: text without reference lines (unstripped test: indented ones stay)."""
    return F.array_join(F.filter(lines_of(c), lambda l: ~is_ref_line(l, rx)), "\n")


def blank_ref_lines(c: Column, rx: str = RX_REF_LINE) -> Column:
    """L4: reference lines blanked, so line numbers stay."""
    return F.array_join(F.transform(lines_of(c), lambda l: F.when(is_ref_line(l, rx), F.lit("")).otherwise(l)), "\n")


def ref_line_numbers(df: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """For each reference line of a text, the first (0-based) line whose
    stripped form equals it. Output ``doc, k, line, line_no``."""
    refs = df.select(doc_col, F.posexplode(ref_lines(F.col(text_col))).alias("k", "line"))
    all_lines = (df.select(doc_col, F.posexplode(lines_of(F.col(text_col))).alias("line_no", "raw"))
                 .select(doc_col, "line_no", py_strip(F.col("raw")).alias("line"))
                 .groupBy(doc_col, "line").agg(F.min("line_no").alias("line_no")))
    return refs.join(all_lines, [doc_col, "line"], "left")


def restore_lines(text: DataFrame, saved: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """Put saved lines ``(doc, line_no, line)`` back into the text when
    that line is blank; ``conflicts`` counts saved lines that met a non-blank
    line or fell past the end (null line numbers count too)."""
    tl = text.select(doc_col, F.posexplode(lines_of(F.col(text_col))).alias("line_no", "cur"))
    j = tl.join(saved.select(doc_col, "line_no", "line"), [doc_col, "line_no"], "left")
    put = F.when(F.col("line").isNotNull() & (py_strip(F.col("cur")) == ""), F.col("line")).otherwise(F.col("cur"))
    rebuilt = (j.groupBy(doc_col)
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", put.alias("l")))),
                                             lambda x: x["l"]), "\n").alias(text_col)))
    placed = j.where(F.col("line").isNotNull() & (py_strip(F.col("cur")) == "")).groupBy(doc_col).agg(
        F.count("*").alias("n_placed"))
    total = saved.groupBy(doc_col).agg(F.count("*").alias("n_saved"))
    return (rebuilt.join(total, doc_col, "left").join(placed, doc_col, "left")
            .select(doc_col, text_col,
                    (F.coalesce("n_saved", F.lit(0)) - F.coalesce("n_placed", F.lit(0))).alias("conflicts")))


def carry_forward(states: Column) -> Column:
    """The last non-null state up to each place of an array (false before any)."""

    def run(x: pa.Array) -> pa.Array:
        values, at = list_rows(x)
        told = ~np.asarray(pc.is_null(values))
        value = np.asarray(pc.fill_null(values, False))
        last = np.maximum.accumulate(np.where(told, np.arange(len(told)), -1)) if len(told) else np.zeros(0, np.int64)
        row = np.repeat(at[:-1], np.diff(at))
        return as_lists(at, pa.array(np.where(last >= row, value[last], False), pa.bool_()))

    @F.arrow_udf("array<boolean>")
    def carry(x: pa.Array) -> pa.Array:
        return in_runs(run, x)

    return carry(states)


def tags_of(text: Column, user_files=()) -> Column:
    """L8 in the row: per line, whether it lies in a tagged (non-user) section.

    A marker line with flag 3 switches off; flag 1 or 2 switches on unless
    the file's base name is a user file; other lines inherit the state."""
    def state(line):
        flag = F.trim(F.regexp_extract(line, RX_MARKER, 3))
        name = F.regexp_extract(F.regexp_extract(line, RX_MARKER, 2), "([^/]*)$", 1)
        user = name.isin(list(user_files)) if user_files else F.lit(False)
        return (F.when(~line.rlike(RX_MARKER) | (flag == ""), F.lit(None).cast("boolean"))
                .when(flag == "3", F.lit(False)).when(flag.isin("1", "2"), ~user))
    return carry_forward(F.transform(lines_of(text), state))


def section_tags(df: DataFrame, doc_col: str, text_col: str, user_files=()) -> DataFrame:
    """L8 as rows ``doc, line_no (1-based), tagged``."""
    tags = df.select(doc_col, tags_of(F.col(text_col), user_files).alias("_tags"))
    return tags.select(doc_col, F.posexplode("_tags").alias("i", "tagged")).select(
        doc_col, (F.col("i") + 1).alias("line_no"), "tagged")


def first_after(token_lines: Column, n_lines: Column) -> Column:
    """L11 in the row: for each line, the first token on a later line, from
    the (never falling) lines of the tokens; null if none."""

    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        values, at = list_rows(x)
        values = values.to_numpy(zero_copy_only=False)
        size = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [np.searchsorted(values[a:b], np.arange(1, k + 1), side="right") for a, b, k in zip(at[:-1], at[1:], size)]
        none = [f == b - a for f, a, b in zip(found, at[:-1], at[1:])]
        join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
        return as_lists(np.concatenate([[0], np.cumsum(size)]), pa.array(join(found, np.int32), mask=join(none, bool)))

    @F.arrow_udf("array<int>")
    def first(x: pa.Array, n: pa.Array) -> pa.Array:
        return in_runs(run, x, n)

    return first(token_lines, n_lines)


def shift_positions(ops: DataFrame, blocks: DataFrame, key_cols: list[str]) -> DataFrame:
    """Each position moves right by the total length of the blocks that
    start at or before it (``ops``: key, op_id, pos; ``blocks``: key, pos,
    length). A sweep over both, united: one running sum a key, no pairs; one
    output row per distinct ``(key, op_id, pos)``, and an operation that is
    listed n times moves n times. Operations of a null key or position meet no
    block."""
    o = ops.groupBy(*key_cols, "op_id", "pos").agg(F.count("*").alias("_times")).select(
        *key_cols, "op_id", "pos", F.lit(None).cast("long").alias("_len"), "_times")
    b = blocks.select(*key_cols, F.lit(None).cast(ops.schema["op_id"].dataType).alias("op_id"), "pos",
                      F.col("length").cast("long").alias("_len"), F.lit(None).cast("long").alias("_times"))
    whole = F.col("pos").isNotNull()
    for k in key_cols:
        whole = whole & F.col(k).isNotNull()
    so_far = Window.partitionBy(*key_cols).orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    moved = o.unionByName(b.where(whole)).withColumn("_sum", F.sum("_len").over(so_far)).where("_times is not null")
    return moved.select(*key_cols, "op_id", "pos",
                        (F.col("pos") + F.when(whole, F.coalesce("_sum", F.lit(0)) * F.col("_times")).otherwise(0)).alias("new_pos"))
