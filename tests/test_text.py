"""Cleaning on literal texts with hand-written results; section fixture."""

import pytest

from pyspark.sql import functions as F

from repairmine.functions import clean as C
from repairmine.operators import lines as L
from repairmine.operators import tokens as K

CLEANED = [
    ("", ""),
    ("int  x ;", "int x ;"),
    ("\ufeffint\u3000x;", "int x;"),
    ("x = 1; // note\ny = 2;", "x = 1; \ny = 2;"),
    ('s = "a // b"; // c', 's = "a // b" ; '),
    ("a /* m\n n */ b", "a  b"),
    ("c = '\"';", "c = '\"' ;"),
    ("a\r\n\n\t\nb", "a \nb"),
    ("\n \n", ""),
    ("#include <a.h>\r\n\tint  x ;", "#include <a.h> \n int x ;"),
]


def test_clean_of_literal_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i int, t string")
    got = dict(df.select("i", C.clean_code(F.col("t")).alias("c")).collect())
    assert [got[i] for i in range(len(CLEANED))] == [c for _, c in CLEANED]


@pytest.mark.parametrize("text,tokens", [
    ("x = 0x1F;", ["x", "=", "0x1F", ";"]), ("1e5+2.5e-3f", ["1e5", "+", "2.5e-3f"]), ("10UL 7 .5 3.", ["10UL", "7", ".5", "3."]),
    ('L"a b" L\'c\' Lx', ['L"a b"', "L'c'", "Lx"]), ("a->b<<=2", ["a", "->", "b", "<<=", "2"]), ("017 1..2", ["017", "1.", ".2"])])
def test_literals_are_one_token(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(K.tokens_of(F.col("t")).alias("k")).first()["k"] == tokens


def test_section_tags(spark):
    text = "\n".join(['# 1 "main.c"', "int a;", '# 1 "/usr/include/stdio.h" 1', "int b;",
                      '# 5 "main.c" 2', "int c;", '# 2 "/usr/include/x.h" 3', "int d;"])
    df = spark.createDataFrame([(1, text)], "doc long, text string")
    t = dict(L.section_tags(df, "doc", "text", user_files=("main.c",)).select("line_no", "tagged").collect())
    assert [t[i] for i in range(1, 9)] == [False, False, True, True, False, False, False, False]


def test_places_of_tokens_in_the_row(spark):
    """Offsets, lines and columns against a scan of the text; null, empty and
    blank texts, comments and line breaks inside tokens; no shuffle."""
    texts = ["int a;\n  b = 2;", None, "", " \n\t", "x /* a\nb */ y // c\n\nz", "é  ü\nñ", "\n\nfirst", 'a "s\\n" b', "x" * 3000 + "\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(2)
    t = K.token_table(df, "doc", "text")
    got = {}
    for x in t.collect():
        got.setdefault(x.doc, []).append((x.pos, x.tok, x.off, x.line, x.col))
    for i, text in enumerate(texts):
        for pos, tok, off, line, col in sorted(got.get(i, [])):
            assert text[off:off + len(tok)] == tok and line == text[:off].count("\n") + 1
            assert col == off - max(text.rfind("\n", 0, off), 0) + 1
    assert [len(got.get(i, [])) for i in range(9)] == [7, 0, 0, 0, 3, 3, 1, 3, 2]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_first_token_on_a_later_line(spark):
    df = spark.createDataFrame([(1, [1, 1, 3], 4), (2, [], 2), (3, None, None), (4, [2], 1)], "i int, lines array<int>, n int")
    got = {x.i: x.f for x in df.select("i", L.first_after(F.col("lines"), F.col("n")).alias("f")).collect()}
    assert got == {1: [2, 2, None, None], 2: [None, None], 3: [], 4: [0]}


def test_sweep_over_a_hot_key(spark):
    """100,000 blocks of one key, nulls and repeated operations."""
    from time import time
    n = 100_000
    blocks = spark.range(n).selectExpr("'hot' as k", "id * 2 as pos", "3 as length").union(
        spark.sql("select cast(null as string), 1L, 5 union all select 'b', cast(null as bigint), 7"))
    ops = spark.range(n).selectExpr("'hot' as k", "id as op_id", "id * 2 + id % 2 as pos").union(
        spark.sql("select 'b', 1L, 10L union all select cast(null as string), 2L, 10L union all select 'hot', 3L, cast(null as bigint)"))
    t = time()
    got = {(x.k, x.op_id): x.new_pos for x in L.shift_positions(ops, blocks, ["k"]).where("pos is not null").collect()}
    assert time() - t < 30
    assert len(got) == n + 2 and got[("b", 1)] == 10 and got[(None, 2)] == 10
    assert all(got[("hot", i)] == i * 2 + i % 2 + 3 * (i + 1) for i in range(0, n, 997))
