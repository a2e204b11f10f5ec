"""Token operators (K1-K8).

One regular expression over the corpus replaces the per-row lexer. Each
match is ``(gap)(token)`` where the gap is blanks and comments, so the
pieces cover the text and a running sum gives exact offsets and line
numbers. Per-document work on token arrays stays inside the row, places
included; the long token table ``(doc, pos, tok, off, line, col)`` is those
arrays exploded, built only where a relational step needs it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairmine.functions.dicts import C_KEYWORDS, C_OPERATORS

# Fixed patterns (valid in Java and RE2). Longest operators first.
RX_GAP = "(?:[ \\t\\n\\x0B\\f\\r]|//[^\\n]*|/\\*(?s:.*?)\\*/)*"
RX_TOKEN_BODY = (
    "#include[^\\n]+"
    "|L?\"(?:[^\"\\\\\\n]|\\\\[^\\n])*\""
    "|L?'(?:[^'\\\\\\n]|\\\\[^\\n])*'"
    "|[A-Za-z_][A-Za-z0-9_]*"
    "|0[xX][0-9A-Fa-f]+[uUlL]*"
    "|(?:[0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?[uUlLfF]*"
    "|->\\*|\\.\\.\\.|<<=|>>=|->|::|\\.\\*|\\+\\+|--|<<|>>|<=|>=|==|!=|&&|\\|\\||\\*=|/=|%=|\\+=|-=|&=|\\^=|\\|="
    "|[^ \\t\\n\\x0B\\f\\r]"
)
RX_PIECE = f"({RX_GAP})({RX_TOKEN_BODY})"
RX_IDENT = "^[A-Za-z_][A-Za-z0-9_]*$"
RX_LITERAL = "^(?:[0-9]|\\.[0-9]|L?[\"'])"

# Token classes.
KEYWORD, OPERATOR, IDENTIFIER, LITERAL, REFERENCE, OTHER = (
    "keyword", "operator", "identifier", "literal", "reference", "other")


def bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: Spark does not share repeated
    subexpressions inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens_of(c: Column) -> Column:
    """K1 (array form): token values of a text, in order."""
    return F.regexp_extract_all(c, F.lit(RX_PIECE), 2)


def gaps_of(c: Column) -> Column:
    """The gap (blanks and comments) before each token."""
    return F.regexp_extract_all(c, F.lit(RX_PIECE), 1)


def list_rows(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and where each row's begin (null: empty)."""
    size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return x.flatten(), np.concatenate([[0], np.cumsum(size)])


def as_lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def _counts(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


#: Values of list columns that one step of an Arrow function takes together. A
#: batch holds rows by the thousand, whatever their length; the working arrays
#: of a step are some twenty numbers a value.
STEP_VALUES = 1 << 17


def in_runs(step, *columns: pa.Array) -> pa.Array:
    """``step(*columns)`` by runs of rows whose lists of the first column hold
    about ``STEP_VALUES`` values (a longer row goes alone), joined."""
    size = pc.fill_null(pc.list_value_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    parts, a, n = [], 0, len(size)
    while a < n:
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + STEP_VALUES, side="right")))
        parts.append(step(*[c.slice(a, b - a) for c in columns]))
        a = b
    return step(*columns) if not parts else parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def places_of(gaps: Column, toks: Column) -> Column:
    """K4: struct of arrays ``off`` (0-based character offset), ``line``
    (1-based) and ``col`` (``off - (last newline before it, or 0) + 1``) of
    the tokens: running sums over the pieces of a row, a run of rows at a time."""

    def run(g: pa.Array, t: pa.Array) -> pa.Array:
        gap, at = list_rows(g)
        tok, _ = list_rows(t)
        glen, tlen = _counts(pc.utf8_length(gap)), _counts(pc.utf8_length(tok))
        gnl, tnl = _counts(pc.count_substring(gap, "\n")), _counts(pc.count_substring(tok, "\n"))
        last = lambda x, n: n - 1 - _counts(pc.find_substring(pc.utf8_reverse(x), "\n"))
        row = np.repeat(np.arange(len(g)), np.diff(at))
        start = np.cumsum(glen + tlen) - glen - tlen  # over the whole run
        lines = np.cumsum(gnl + tnl) - gnl - tnl
        first = np.minimum(at[:-1], max(len(start) - 1, 0))[row]
        in_gap = np.where(gnl > 0, start + last(gap, glen), -1)
        in_piece = np.where(tnl > 0, start + glen + last(tok, tlen), in_gap)
        before = np.concatenate([[-1], np.maximum.accumulate(in_piece)[:-1]]) if len(in_piece) else in_piece
        newline = np.where(in_gap >= 0, in_gap, before)
        off = start + glen
        head = start[first] if len(start) else start
        newline = np.where(newline >= head, newline - head, 0)
        off = off - head
        line = lines - (lines[first] if len(lines) else lines) + gnl + 1
        out = [as_lists(at, pa.array(x.astype(np.int32))) for x in (off, line, off - newline + 1)]
        return pa.StructArray.from_arrays(out, names=["off", "line", "col"])

    @F.arrow_udf("struct<off:array<int>,line:array<int>,col:array<int>>")
    def places(g: pa.Array, t: pa.Array) -> pa.Array:
        return in_runs(run, g, t)

    return places(gaps, toks)


#: Values that one fold of :func:`before_each` takes (a fold copies its state at
#: every step), and how often its stretches are cut into stretches.
STRETCH, LEVELS = 16, 3


def before_each(values: Column, op, none: Column, levels: int = LEVELS) -> Column:
    """For each value of an array, ``op`` over all values before it. ``op`` is
    associative; ``none``, the result for the first, leaves a value as it is.
    In Spark expressions: a row that is sent to a Python worker waits for it
    in memory or on disk, with all its columns."""

    def folded(x, first):
        done = F.aggregate(x, F.array(first), lambda a, v: F.array_append(a, op(F.element_at(a, -1), v)))
        return F.slice(done, 1, F.size(x))

    def by_stretch(parts):
        starts = before_each(F.transform(parts, lambda x: F.aggregate(x, none, op)), op, none, levels - 1)
        return F.flatten(F.zip_with(parts, starts, folded))

    def cut(x):
        at = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(STRETCH))
        return F.transform(at, lambda i: F.slice(x, i + 1, STRETCH))
    return bind(values, lambda x: bind(cut(x), by_stretch) if levels else folded(x, none))


def row_places(gaps: Column, toks: Column) -> Column:
    """``off`` and ``line`` of :func:`places_of` in Spark expressions, by
    :func:`before_each`."""
    empty, nl, zero = F.array().cast("array<string>"), F.lit("\n"), F.lit(0).cast("bigint")

    def measure(x):  # length, and line breaks from bit 32 on: summed together
        breaks = F.length(x) - F.length(F.replace(x, nl, F.lit("")))
        return F.length(x) + F.when(F.contains(x, nl), F.shiftleft(breaks.cast("bigint"), 32)).otherwise(zero)

    def starts(gap):
        pieces = F.zip_with(gap, F.coalesce(toks, empty), lambda g, t: g + measure(t))
        return F.zip_with(before_each(pieces, lambda a, b: a + b, zero), gap, lambda a, g: a + g)

    def told(at):
        return F.struct(F.transform(at, lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int")).alias("off"),
                        F.transform(at, lambda x: F.shiftright(x, 32).cast("int") + 1).alias("line"))
    return bind(bind(F.transform(F.coalesce(gaps, empty), measure), starts), told)


def with_tokens(df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
    """K1 + K4 in the row: ``out``, an array of ``tok, off, line, col``."""
    df = df.withColumns({"_gaps": gaps_of(F.col(text_col)), "_toks": tokens_of(F.col(text_col))})
    df = df.withColumn("_places", places_of(F.col("_gaps"), F.col("_toks")))
    at = [F.col(f"_places.{c}").alias(c) for c in ("off", "line", "col")]
    return df.withColumn(out, F.arrays_zip(F.col("_toks").alias("tok"), *at)).drop("_gaps", "_toks", "_places")


def token_table(df: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """K1 + K4: long token table ``doc, pos, tok, off, line, col``, without a
    shuffle or a window."""
    t = with_tokens(df.select(doc_col, text_col), text_col, "_tokens")
    return t.select(doc_col, F.posexplode("_tokens").alias("pos", "e")).select(doc_col, "pos", "e.*")


def token_class(tok: Column) -> Column:
    """K2: keyword / operator / identifier / literal / reference / other."""
    return (F.when(tok.isin(*C_KEYWORDS), F.lit(KEYWORD))
            .when(tok.isin(*C_OPERATORS), F.lit(OPERATOR))
            .when(tok.startswith("#include"), F.lit(REFERENCE))
            .when(tok.rlike(RX_IDENT), F.lit(IDENTIFIER))
            .when(tok.rlike(RX_LITERAL), F.lit(LITERAL))
            .otherwise(F.lit(OTHER)))


def identifier_set(toks: Column) -> Column:
    """K3: the sorted distinct token values of a text that are not predefined
    (keywords, operators, reference lines)."""
    return F.array_sort(F.array_distinct(F.filter(
        toks, lambda t: ~t.isin(*C_KEYWORDS) & ~t.isin(*C_OPERATORS) & ~t.startswith("#include"))))


def piece_before(tok: Column, off: Column, line: Column, prev_tok: Column, prev_off: Column, prev_line: Column) -> Column:
    """A token with what stands before it: line breaks by the line difference,
    then blanks ``off - prev_off - (len(prev), or the line difference + 1 after
    a break)``."""
    nl = line - prev_line
    pad = off - prev_off - F.when(nl != 0, nl + 1).otherwise(F.length(prev_tok))
    return F.concat(F.repeat(F.lit("\n"), F.greatest(nl, F.lit(0))), F.repeat(F.lit(" "), F.greatest(pad, F.lit(0))), tok)


def text_of(tokens: Column) -> Column:
    """K5: text from an array of ``tok, off, line``, in the row."""
    def piece(x, i):
        old = F.get(tokens, i - 1)
        return piece_before(x["tok"], x["off"], x["line"], F.coalesce(old["tok"], F.lit("")),
                            F.coalesce(old["off"], F.lit(0)), F.coalesce(old["line"], F.lit(1)))
    return F.array_join(F.transform(tokens, piece), "")


def rebuild_text(tt: DataFrame, doc_col: str) -> DataFrame:
    """K5: text from a long table ``(pos, tok, off, line)``."""
    tokens = F.array_sort(F.collect_list(F.struct("pos", "tok", "off", "line")))
    return tt.groupBy(doc_col).agg(tokens.alias("_tokens")).select(doc_col, text_of(F.col("_tokens")).alias("text"))


def window_matches(toks: Column, preds) -> Column:
    """K6: start positions where ``preds[k](toks[i + k])`` holds for all k."""
    w = len(preds)
    n = F.size(toks)

    def ok(i):
        cond = i <= n - w
        for k, p in enumerate(preds):
            cond = cond & p(F.try_element_at(toks, i + k + 1))
        return F.coalesce(cond, F.lit(False))
    return F.filter(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), ok)


def spans(toks: Column, begin: str, end: str) -> Column:
    """K7: for each ``begin`` token, ``(b, e)`` with ``e`` the first ``end``
    token after it, or the last token when there is none."""
    n = F.size(toks)
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    starts = F.filter(idx, lambda i: F.coalesce(F.try_element_at(toks, i + 1) == begin, F.lit(False)))

    def first_end(i):
        found = F.array_min(F.filter(idx, lambda j: (j > i) & (F.try_element_at(toks, j + 1) == end)))
        return F.struct(i.alias("b"), F.coalesce(found, n - 1).alias("e"))
    return F.transform(starts, first_end)


def within_cap(toks: Column, cap: int) -> Column:
    """K8: token count cap."""
    return F.size(toks) <= cap
