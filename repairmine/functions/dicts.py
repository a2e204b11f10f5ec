"""Fixed dictionaries and their encode/decode columns (P5, P6, K2 classes)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict codes.
VERDICT = {
    "OK": 1, "REJECTED": 2, "WRONG_ANSWER": 3, "RUNTIME_ERROR": 4, "TIME_LIMIT_EXCEEDED": 5,
    "MEMORY_LIMIT_EXCEEDED": 6, "COMPILATION_ERROR": 7, "CHALLENGED": 8, "FAILED": 9, "PARTIAL": 10,
    "PRESENTATION_ERROR": 11, "IDLENESS_LIMIT_EXCEEDED": 12, "SECURITY_VIOLATED": 13, "CRASHED": 14,
    "INPUT_PREPARATION_CRASHED": 15, "SKIPPED": 16, "TESTING": 17, "SUBMITTED": 18,
}

# Language codes.
LANGUAGE = {
    "GNU C": 1, "GNU C11": 2, "GNU C++": 3, "GNU C++11": 4, "GNU C++14": 5,
    "MS C++": 6, "Mono C#": 7, "MS C#": 8, "D": 9, "Go": 10,
    "Haskell": 11, "Java 8": 12, "Kotlin": 13, "Ocaml": 14, "Delphi": 15,
    "FPC": 16, "Perl": 17, "PHP": 18, "Python 2": 19, "Python 3": 20,
    "PyPy 2": 21, "PyPy 3": 22, "Ruby": 23, "Rust": 24, "Scala": 25,
    "JavaScript": 26,
}

# C keywords (as written in source text).
C_KEYWORDS = (
    "_Bool", "_Complex", "auto", "break", "case", "char", "const",
    "continue", "default", "do", "double", "else", "enum", "extern",
    "float", "for", "goto", "if", "inline", "int", "long",
    "register", "offsetof",
    "restrict", "return", "short", "signed", "sizeof", "static", "struct",
    "switch", "typedef", "union", "unsigned", "void",
    "volatile", "while", "__int128",
)

# C operators and delimiters.
C_OPERATORS = (
    "+", "-", "*", "/", "%", "|", "&", "~", "^", "<<", ">>", "||", "&&", "!",
    "<", ">", "<=", ">=", "==", "!=",
    "=", "*=", "/=", "%=", "+=", "-=", "<<=", ">>=", "&=", "|=", "^=",
    "++", "--", "->", "?",
    "(", ")", "[", "]", ",", ".", ";", ":", "...",
)

# Verdict sets used by the jobs.
PASS_CODES = (1,)
COMPILE_FAIL_CODES = (7,)
TEST_FAIL_CODES = (3, 4, 5, 6)
PASS_OR_WRONG = (1, 3)
KEEP_FOR_TEST_MINING = (1, 3, 4, 5, 6)


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def encode(c: Column, d: dict) -> Column:
    """P5: code of a value (null when unmapped; keep the raw column too)."""
    return map_literal(d)[c]


def decode(c: Column, d: dict) -> Column:
    """Value of a code; the inverted map keeps the last key of a code."""
    inv = {}
    for k, v in d.items():
        inv[v] = k
    return map_literal(inv)[c]
