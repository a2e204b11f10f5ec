"""Column functions for text cleaning (C1-C7, C9) and small projections.

Everything is a built-in expression (codegen, no Python per row). The regular
expressions are written so that Java's engine gives the results of Python's
``re`` on the same text: ``(?d)`` makes ``.`` and ``$`` stop only at ``\\n``,
``\\x0B`` replaces ``\\v`` (a class holding ``\\n`` in Java), and Python's
Unicode blank test is spelled out as a class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (Java syntax).
RX_BLANK = "(?d)('.*?'|\".*?\"|[^ \\t\\r\\f\\x0B\"']+)"
RX_COMMENT = "(?dms)(\".*?(?<!\\\\)\"|'.*?(?<!\\\\)')|(/\\*.*?\\*/|//[^\\r\\n]*$)"
# Python str.isspace() as a class: Unicode White_Space plus \x1c-\x1f.
PY_SPACE = "(?U)[\\s\\x1c-\\x1f]"
RX_PY_STRIP = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
# Preprocessor words whose presence drops a text (plain substring test).
DIRECTIVE_WORDS = ("define", "defined", "undef", "pragma", "ifndef", "ifdef", "endif")

# The same rules in RE2 syntax, for DuckDB oracles.
RE2_PY_SPACE = "[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]"


def strip_odd_chars(c: Column) -> Column:
    """Drop the byte-order mark, ideographic space -> space."""
    return F.translate(F.regexp_replace(c, "\ufeff", ""), "\u3000", " ")


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks outside quotes become one space; a quote that is
    never closed is dropped."""
    return F.array_join(F.regexp_extract_all(c, F.lit(RX_BLANK), 1), " ")


def drop_cr(c: Column) -> Column:
    """Remove carriage returns."""
    return F.regexp_replace(c, "\r", "")


def strip_comments(c: Column) -> Column:
    """C4: remove ``//`` and ``/* */`` comments; quoted strings stay."""
    return F.regexp_replace(c, F.lit(RX_COMMENT), F.lit("$1"))


def is_blank(c: Column) -> Column:
    """Python ``s.strip() == ''`` for one line."""
    return F.regexp_replace(c, PY_SPACE + "+", "") == ""


def py_strip(c: Column) -> Column:
    """Python ``s.strip()``."""
    return F.regexp_replace(c, RX_PY_STRIP, "")


def drop_blank_lines(c: Column) -> Column:
    """Remove lines that are blank by Python's test."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda l: ~is_blank(l)), "\n")


def clean_code(c: Column) -> Column:
    """C1 -> C2 -> C3 -> C4 -> C5, in this order."""
    return drop_blank_lines(strip_comments(drop_cr(collapse_blanks(strip_odd_chars(c)))))


def is_ascii(c: Column) -> Column:
    """Every character below 128."""
    return F.length(c) == F.octet_length(c)


def has_directive(c: Column) -> Column:
    """C9 (first half): plain substring test for preprocessor words."""
    cond = None
    for w in DIRECTIVE_WORDS:
        t = F.instr(c, w) > 0
        cond = t if cond is None else (cond | t)
    return cond


def strip_unit(c: Column, unit: str) -> Column:
    """``"15 ms"`` -> 15 (null when not a number)."""
    return F.trim(F.replace(c, F.lit(unit), F.lit(""))).try_cast("int")


def trim_ends(c: Column) -> Column:
    """Drop the first and the last character."""
    return F.when(F.length(c) < 2, F.lit("")).otherwise(F.substr(c, F.lit(2), F.length(c) - 2))


def once(c: Column) -> Column:
    """``c`` as a generated column: a filter on it stays above it. A filter on
    a projected column is pushed below the projection with the expression
    inlined, once for every mention."""
    return F.explode(F.array(c))
