"""Edit scripts: both Spark forms against a plain sequential implementation."""

import random

import pytest
from pyspark.sql import functions as F

from repairmine.operators.edits import (apply_sql, matrix_sql, script_sql, script_text, with_script_arrow,
                                        _script_arrays)


def reference_script(a, b):
    """Sequential DP and trace-back (diagonal, then insert, then delete)."""
    n, m = len(a), len(b)
    M = [[0] * (m + 1) for _ in range(n + 1)]
    for j in range(m + 1):
        M[0][j] = j
    for i in range(1, n + 1):
        M[i][0] = i
        for j in range(1, m + 1):
            M[i][j] = min(M[i][j - 1] + 1, M[i - 1][j] + 1, M[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    out, i, j = [], n, m
    while i > 0 or j > 0:
        if i == 0:
            out.append((3, j - 1, b[j - 1], "")); j -= 1
        elif j == 0:
            out.append((1, 0, "", a[i - 1])); i -= 1
        else:
            c = int(a[i - 1] != b[j - 1])
            if M[i][j] == M[i - 1][j - 1] + c:
                if c:
                    out.append((4, j - 1, b[j - 1], a[i - 1]))
                i, j = i - 1, j - 1
            elif M[i][j] == M[i - 1][j] + 1:
                out.append((1, j, "", a[i - 1])); i -= 1
            else:
                out.append((3, j - 1, b[j - 1], "")); j -= 1
    return M[n][m], out


def apply(b, acts):
    t = list(b)
    for act, pos, _frm, to in acts:
        if act == 1:
            t = t[:pos] + [to] + t[pos:]
        elif act == 3:
            t = t[:pos] + t[pos + 1:]
        else:
            t = t[:pos] + [to] + t[pos + 1:]
    return t


def cases():
    rnd = random.Random(3)
    out = [("", ""), ("", "ab"), ("ab", ""), ("kitten", "sitting"), ("abc", "abc")]
    for _ in range(40):
        out.append(("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))),
                    "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))))
    return out


def test_numpy_form_matches_reference():
    for a, b in cases():
        d, ref = reference_script(a, b)
        acts, pos, frm, to = _script_arrays(a, b, d, list(a), list(b))
        assert list(zip(acts, pos, frm, to)) == ref
        assert len(ref) == d
        assert "".join(apply(b, ref)) == a


def test_spark_forms_match_reference(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "a string, b string")
    df = (df.withColumn("ta", F.when(F.col("a") == "", F.array().cast("array<string>"))
                        .otherwise(F.split("a", "(?!$)")))
            .withColumn("tb", F.when(F.col("b") == "", F.array().cast("array<string>"))
                        .otherwise(F.split("b", "(?!$)")))
            .withColumn("m", F.expr(matrix_sql("a", "b")))
            .withColumn("hof", F.expr(script_sql("m", "a", "b", "ta", "tb"))))
    df = with_script_arrow(df, "a", "b", "ta", "tb", out="arrow")
    df = df.withColumn("applied", F.expr(apply_sql("tb", "hof")))
    got = {(r["a"], r["b"]): r for r in df.collect()}
    for a, b in rows:
        _, ref = reference_script(a, b)
        r = got[(a, b)]
        assert [tuple(x) for x in r["hof"]] == ref
        assert [tuple(x) for x in r["arrow"]] == ref
        assert "".join(r["applied"]) == a
