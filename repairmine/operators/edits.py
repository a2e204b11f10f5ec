"""Distance matrix, edit scripts and their application.

All three are built-in higher-order expressions evaluated on executors. They
run only on the winning pairs of a nearest search (two-phase plan: distance
and arg-min first, matrix and trace-back after the aggregate).

Edit actions are ``struct<act:int, pos:int, frm:string, to:string>`` with the
codes below. A script leads from the passing sequence ``b`` to the failing
sequence ``a`` and lists the last position first, so applying it in order
needs no position shift.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Action codes.
NORMAL = 0
INSERT_BEFORE = 1
INSERT_AFTER = 2
DELETE = 3
CHANGE = 4

ACTION_TYPE = "struct<act:int,pos:int,frm:string,to:string>"
ACTIONS_TYPE = f"array<{ACTION_TYPE}>"


def matrix_sql(a: str, b: str) -> str:
    """D3: full ``(len(a)+1) x (len(b)+1)`` matrix of two symbol strings."""
    return f"""if(length({a}) = 0, array(sequence(0, length({b}))),
      aggregate(sequence(1, length({a})), array(sequence(0, length({b}))),
        (rows, i) -> concat(rows, array(
          if(length({b}) = 0, array(i),
            aggregate(sequence(1, length({b})), array(i),
              (row, j) -> concat(row, array(least(row[j - 1] + 1, rows[i - 1][j] + 1,
                  rows[i - 1][j - 1] + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1))))))))))"""


def distance_matrix(a: str, b: str) -> Column:
    return F.expr(matrix_sql(a, b))


def script_sql(m: str, a: str, b: str, ta: str, tb: str) -> str:
    """Trace-back from the last cell; diagonal first, then insert (top),
    then delete (left). ``ta``/``tb`` are the token value arrays."""
    step = f"""(s, k) -> case
      when s.i = 0 and s.j = 0 then s
      when s.i = 0 then named_struct('i', s.i, 'j', s.j - 1, 'acts', concat(s.acts, array(
          named_struct('act', {DELETE}, 'pos', s.j - 1, 'frm', element_at({tb}, s.j), 'to', ''))))
      when s.j = 0 then named_struct('i', s.i - 1, 'j', s.j, 'acts', concat(s.acts, array(
          named_struct('act', {INSERT_BEFORE}, 'pos', 0, 'frm', '', 'to', element_at({ta}, s.i)))))
      when {m}[s.i][s.j] = {m}[s.i - 1][s.j - 1] + if(substr({a}, s.i, 1) = substr({b}, s.j, 1), 0, 1)
        then named_struct('i', s.i - 1, 'j', s.j - 1, 'acts',
          if(substr({a}, s.i, 1) = substr({b}, s.j, 1), s.acts, concat(s.acts, array(
            named_struct('act', {CHANGE}, 'pos', s.j - 1, 'frm', element_at({tb}, s.j), 'to', element_at({ta}, s.i))))))
      when {m}[s.i][s.j] = {m}[s.i - 1][s.j] + 1
        then named_struct('i', s.i - 1, 'j', s.j, 'acts', concat(s.acts, array(
          named_struct('act', {INSERT_BEFORE}, 'pos', s.j, 'frm', '', 'to', element_at({ta}, s.i)))))
      else named_struct('i', s.i, 'j', s.j - 1, 'acts', concat(s.acts, array(
          named_struct('act', {DELETE}, 'pos', s.j - 1, 'frm', element_at({tb}, s.j), 'to', ''))))
    end"""
    zero = (f"named_struct('i', length({a}), 'j', length({b}), "
            f"'acts', cast(array() as {ACTIONS_TYPE}))")
    return f"aggregate(sequence(1, greatest(length({a}) + length({b}), 1)), {zero}, {step}).acts"


def edit_script(m: str, a: str, b: str, ta: str, tb: str) -> Column:
    return F.expr(script_sql(m, a, b, ta, tb))


def apply_sql(tokens: str, acts: str) -> str:
    """Apply a script to a token array, in list order."""
    return f"""aggregate({acts}, {tokens}, (acc, x) -> case x.act
      when {INSERT_BEFORE} then concat(slice(acc, 1, x.pos), array(x.to), slice(acc, x.pos + 1, greatest(size(acc), 1)))
      when {DELETE} then concat(slice(acc, 1, x.pos), slice(acc, x.pos + 2, greatest(size(acc), 1)))
      else concat(slice(acc, 1, x.pos), array(x.to), slice(acc, x.pos + 2, greatest(size(acc), 1))) end)"""


def apply_script(tokens: str, acts: str) -> Column:
    return F.expr(apply_sql(tokens, acts))


def action_json_fields(x: Column) -> Column:
    """The stored form of an action."""
    return F.struct(x["act"].alias("act_type"), x["frm"].alias("from_char"), x["to"].alias("to_char"),
                    x["pos"].alias("token_pos"))


def build_actions(acts: Column, builders: dict | None = None, default=action_json_fields) -> Column:
    """A script through one builder per action code (``Column ->
    Column``, all of one type); codes without a builder use ``default``."""
    def one(x):
        out = None
        for code, build in (builders or {}).items():
            out = F.when(x["act"] == code, build(x)) if out is None else out.when(x["act"] == code, build(x))
        return default(x) if out is None else out.otherwise(default(x))
    return F.transform(acts, one)


def script_text(acts: Column) -> Column:
    """Flat text of a script, ``act:pos:frm:to`` joined by ';'."""
    return F.array_join(F.transform(acts, lambda x: F.concat_ws(
        ":", x["act"].cast("string"), x["pos"].cast("string"), x["frm"], x["to"])), ";")


# --- Arrow-batched form of D3 + D5 ------------------------------------------
# The higher-order form above runs interpreted and copies arrays on every
# step (O(n * m^2) per pair). The Arrow form knows the distance d (JVM), so it
# fills only the band |i - j| <= d, one byte a cell and one row of numbers at a
# time: O(n * d) time and memory. The row's left-hand dependency
# ``row[j] = min(row[j], row[j-1] + 1)`` is one cumulative minimum. The
# preference order is the same, so both forms give identical scripts (tests).

_ARROW_SCRIPT_TYPE = "struct<act:array<int>,pos:array<int>,frm:array<string>,to:array<string>>"


_SAME, _CHANGED, _TOP, _LEFT = 0, 1, 2, 3


def _moves(A: np.ndarray, B: np.ndarray, d: int) -> np.ndarray:
    """Preferred move into every cell of the band ``|i - j| <= d`` (one byte a
    cell; column ``k`` of row ``i`` is ``j = i + k - d``). An optimal path of
    cost ``d`` never leaves the band, and cells off it only look dearer, so the
    trace-back is that of the full matrix."""
    n, m, width = len(A), len(B), 2 * d + 1
    far = np.int32(1 << 29)
    k = np.arange(width, dtype=np.int32)
    moves = np.full((n + 1, width), _LEFT, dtype=np.uint8)
    prev = np.where((k >= d) & (k - d <= m), k - d, far).astype(np.int32)
    padded = np.full(m + 2 * d + 1, 0xFFFFFFFF, dtype=np.uint32)
    padded[d:d + m] = B
    for i in range(1, n + 1):
        # the cell's token of B is number i + k - d - 1
        at = i - 1
        cost = (padded[at:at + width] != A[i - 1]).astype(np.int32) if at + width <= len(padded) else np.concatenate(
            [padded[at:] != A[i - 1], np.ones(at + width - len(padded), dtype=bool)]).astype(np.int32)
        diagonal = prev + cost
        top = np.append(prev[1:], far) + 1
        j = i + k - d
        cur = np.minimum(diagonal, top)
        cur[(j < 0) | (j > m)] = far
        if i <= d:
            cur[d - i] = i
        cur = np.minimum.accumulate(cur - k) + k
        cur[(j < 0) | (j > m)] = far
        moves[i] = np.where(cur == diagonal, cost, np.where(cur == top, _TOP, _LEFT))
        prev = cur
    return moves


def _script_arrays(a, b, d: int, ta, tb):
    """The script between two symbol strings or two id arrays of distance ``d``."""
    n, m = len(a), len(b)
    if isinstance(a, str):
        A, B = (np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) for x in (a, b))
    else:
        number = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.uint32)
        A, B = number[:n], number[n:]
    # equal ends: the diagonal move is preferred wherever tokens are equal
    k = min(n, m)
    differ = np.flatnonzero(A[n - k:][::-1] != B[m - k:][::-1])
    k = int(differ[0]) if len(differ) else k
    n, m = n - k, m - k
    moves = _moves(A[:n], B[:m], d)
    acts, pos, frm, to = [], [], [], []

    def add(act, at, old, new):
        acts.append(act)
        pos.append(at)
        frm.append(old)
        to.append(new)

    i, j = n, m
    while i > 0 or j > 0:
        move = _LEFT if i == 0 else _TOP if j == 0 else moves[i, j - i + d]
        if move == _TOP:
            add(INSERT_BEFORE, j, "", ta[i - 1])
            i -= 1
        elif move == _LEFT:
            add(DELETE, j - 1, tb[j - 1], "")
            j -= 1
        else:
            if move == _CHANGED:
                add(CHANGE, j - 1, tb[j - 1], ta[i - 1])
            i, j = i - 1, j - 1
    return acts, pos, frm, to


def _arrow_script_udf():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(_ARROW_SCRIPT_TYPE)
    def script_batch(a: pd.Series, b: pd.Series, d: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.DataFrame:
        out = [_script_arrays(x, y, int(k), list(p), list(q)) for x, y, k, p, q in zip(a, b, d, ta, tb)]
        return pd.DataFrame({"act": [o[0] for o in out], "pos": [o[1] for o in out],
                             "frm": [o[2] for o in out], "to": [o[3] for o in out]})
    return script_batch


_UDF = None


def with_script_arrow(df, a: str, b: str, ta: str, tb: str, out: str = "acts", distance: str | None = None):
    """D3 + D5 through Arrow batches: adds ``out`` with the same
    ``array<struct<act, pos, frm, to>>`` as :func:`edit_script`. ``a`` and
    ``b`` are symbol strings, or id arrays with their ``distance`` column."""
    global _UDF
    if _UDF is None:
        _UDF = _arrow_script_udf()
    r = F.col("_script")
    return (df.withColumn("_script", _UDF(
        F.col(a), F.col(b), F.levenshtein(a, b) if distance is None else F.col(distance), F.col(ta), F.col(tb)))
            .withColumn(out, F.transform(r["act"], lambda x, k: F.struct(
                x.alias("act"), r["pos"][k].alias("pos"), r["frm"][k].alias("frm"), r["to"][k].alias("to"))))
            .drop("_script"))
