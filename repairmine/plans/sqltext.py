"""Helpers to write oracle SQL text."""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal (standard SQL: quotes doubled, backslashes literal)."""
    return "'" + s.replace("'", "''") + "'"


def case_map(col: str, d: dict, else_sql: str = "NULL") -> str:
    """CASE expression mapping keys of ``d`` to values."""
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in d.items())
    return f"CASE {col} {arms} ELSE {else_sql} END"


def d_matrix(a: str, b: str) -> str:
    """DuckDB form of the full distance matrix of two symbol strings
    (1-based lists: cell (i, j) is ``mat[i + 1][j + 1]``)."""
    return (f"list_reduce(range(1, length({a}) + 1), lambda rows, i: list_append(rows, "
            f"list_reduce(range(1, length({b}) + 1), lambda row, j: list_append(row, least(row[j] + 1, "
            f"rows[i][j + 1] + 1, rows[i][j] + CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN 0 ELSE 1 END)), "
            f"[i])), [range(0, length({b}) + 1)])")


ACTS_DUCK = 'STRUCT(act INTEGER, pos BIGINT, frm VARCHAR, "to" VARCHAR)[]'


def d_script(mat: str, a: str, b: str, ta, tb) -> str:
    """DuckDB form of the trace-back (same preference order as the Spark
    form). ``ta(i)``/``tb(j)`` give the token value at a 1-based index."""
    cost = "CASE WHEN substr({a}, s.i, 1) = substr({b}, s.j, 1) THEN 0 ELSE 1 END".format(a=a, b=b)

    def act(code, pos, frm, to):
        return f"{{'act': {code}, 'pos': {pos}, 'frm': {frm}, 'to': {to}}}"
    dele = act(3, "s.j - 1", tb("s.j"), "''")
    ins = act(1, "s.j", "''", ta("s.i"))
    ins0 = act(1, "0", "''", ta("s.i"))
    chg = act(4, "s.j - 1", tb("s.j"), ta("s.i"))
    step = (f"CASE WHEN s.i = 0 AND s.j = 0 THEN s "
            f"WHEN s.i = 0 THEN {{'i': s.i, 'j': s.j - 1, 'acts': list_append(s.acts, {dele})}} "
            f"WHEN s.j = 0 THEN {{'i': s.i - 1, 'j': s.j, 'acts': list_append(s.acts, {ins0})}} "
            f"WHEN {mat}[s.i + 1][s.j + 1] = {mat}[s.i][s.j] + {cost} THEN {{'i': s.i - 1, 'j': s.j - 1, 'acts': "
            f"CASE WHEN {cost} = 0 THEN s.acts ELSE list_append(s.acts, {chg}) END}} "
            f"WHEN {mat}[s.i + 1][s.j + 1] = {mat}[s.i][s.j + 1] + 1 THEN {{'i': s.i - 1, 'j': s.j, 'acts': "
            f"list_append(s.acts, {ins})}} "
            f"ELSE {{'i': s.i, 'j': s.j - 1, 'acts': list_append(s.acts, {dele})}} END")
    zero = f"{{'i': CAST(length({a}) AS BIGINT), 'j': CAST(length({b}) AS BIGINT), 'acts': []::{ACTS_DUCK}}}"
    return f"list_reduce(range(1, greatest(length({a}) + length({b}), 1) + 1), lambda s, k: {step}, {zero}).acts"


def d_script_text(acts: str) -> str:
    """Text form of a script, as ``act:pos:frm:to`` joined by ';'."""
    return f"array_to_string(list_transform({acts}, lambda x: x.act || ':' || x.pos || ':' || x.frm || ':' || x.\"to\"), ';')"
