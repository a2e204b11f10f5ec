"""Registered queries: synthetic corruption.

The DuckDB oracles recompute the same md5 draws step by step (one CTE per
step), so plans, applied edits and misspellings are checked value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions.dicts import C_KEYWORDS, C_OPERATORS
from repairmine.operators import corrupt as M
from repairmine.operators import tokens as K
from repairmine.plans.registry import register
from repairmine.plans.sqltext import q
from repairmine.plans.text import D_CLEAN_CTE, D_LINES, D_PIECE, D_REF, D_STRIP, D_SUBT, D_TOKTAB, d, d_ref_line_no
from repairmine.sources.tables import read_table

SEED = 11
PLAN_TEXT = "array_join(transform({p}, e -> concat_ws(':', e.draw, e.act, e.pos, e.frm, e.to)), ';')"


def plan_text(col: str):
    return F.array_join(F.transform(col, lambda e: F.concat_ws(
        ":", e["draw"].cast("string"), e["act"].cast("string"), e["pos"].cast("string"), e["frm"], e["to"])), ";")


def _docs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", K.tokens_of(F.col("text")).alias("toks"))


# --- DuckDB mirrors -----------------------------------------------------------

def dd(doc: str, d: str, tag: str) -> str:
    return (f"(('0x' || substr(md5('{SEED}|' || CAST({doc} AS VARCHAR) || '|' || CAST({d} AS VARCHAR) "
            f"|| '|{tag}'), 1, 8))::BIGINT)")


def dpick(pool: str, doc: str, d: str, tag: str) -> str:
    return f"CASE WHEN len({pool}) > 0 THEN {pool}[({dd(doc, d, tag)} % len({pool})) + 1] END"


def dweighted(weights, doc, d, tag) -> str:
    u = f"({dd(doc, d, tag)} % {sum(weights)})"
    arms, cum = [], 0
    for i, w in enumerate(weights):
        cum += w
        arms.append(f"WHEN {u} < {cum} THEN {i}")
    return "CASE " + " ".join(arms) + " END"


D_KW = "[" + ", ".join(q(x) for x in C_KEYWORDS) + "]"
D_OP = "[" + ", ".join(q(x) for x in C_OPERATORS) + "]"


def d_idents(toks: str) -> str:
    return (f"list_sort(list_distinct(list_filter({toks}, lambda t: NOT list_contains({D_KW}, t) "
            f"AND NOT list_contains({D_OP}, t) AND NOT starts_with(t, '#include'))))")


def d_misspell(name: str, doc: str, d: str) -> str:
    chars = f"list_sort(list_distinct(regexp_extract_all({name}, '(?s).', 0)))"
    c = dpick(chars, doc, d, "mc")
    n = f"length({name})"
    ins = f"(CASE WHEN {n} = 1 THEN true ELSE {dd(doc, d, 'ma')} % 2 = 0 END)"
    ii = f"({dd(doc, d, 'mi')} % ({n} + 1))"
    idl = f"({dd(doc, d, 'md')} % {n})"
    return (f"CASE WHEN {ins} THEN substr({name}, 1, {ii}) || {c} || substr({name}, {ii} + 1) "
            f"ELSE substr({name}, 1, {idl}) || substr({name}, {idl} + 2) END")


def d_replacement(doc: str, frm: str, draw: str) -> str:
    """M3: the new token of a change or insert (null-safe, as text)."""
    return f"""coalesce(CASE WHEN (CASE WHEN {frm} = '' THEN 0
      ELSE {dweighted(M.CHANGE_KIND_WEIGHTS, doc, draw, 'k')} END) = 0 THEN
    CASE WHEN list_contains(idents, {frm}) THEN {dpick('idents', doc, draw, 'w')}
         WHEN list_contains({D_KW}, {frm}) THEN {dpick(D_KW, doc, draw, 'w')}
         WHEN list_contains({D_OP}, {frm}) THEN {dpick(D_OP, doc, draw, 'w')}
         WHEN {dweighted(M.INSERT_CLASS_WEIGHTS, doc, draw, 'c')} = 0 THEN {dpick('idents', doc, draw, 'w')}
         WHEN {dweighted(M.INSERT_CLASS_WEIGHTS, doc, draw, 'c')} = 1 THEN {dpick(D_KW, doc, draw, 'w')}
         ELSE {dpick(D_OP, doc, draw, 'w')} END
    ELSE {d_misspell(frm, doc, draw)} END, '')"""


D_K = "((('0x' || substr(md5('" + str(SEED) + "|' || CAST({doc} AS VARCHAR) || '|k'), 1, 8))::BIGINT) % 9) + 1"


def d_draw_ctes(src: str, doc: str, last: str, pre: str = "p", keep: str = "r") -> str:
    """CTEs ``<pre>1..<pre>4`` over ``src(doc, toks)``: the random edits of the
    draws 1 to ``last``; ``keep`` picks from the draws once their action and
    position are known."""
    act = (f"CASE {dweighted(M.ACTION_WEIGHTS, doc, 'd', 'a')} WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END")
    return f"""{pre}1 AS (SELECT {doc} AS doc, toks, {d_idents('toks')} AS idents, {D_K.format(doc=doc)} AS k,
  list_transform(range(1, {last} + 1), lambda d: {{'draw': d, 'act': {act}}}) AS r FROM {src}),
{pre}2 AS (SELECT doc, toks, idents, k, list_transform(r, lambda e: {{'draw': e.draw, 'act': e.act,
  'pos': CASE WHEN e.act = 1 THEN {dd('doc', 'e.draw', 'p')} % (len(toks) + 1)
         ELSE {dd('doc', 'e.draw', 'p')} % len(toks) END}}) AS r FROM {pre}1),
{pre}3 AS (SELECT doc, toks, idents, list_transform({keep}, lambda e: {{'draw': e.draw, 'act': e.act, 'pos': e.pos,
  'frm': CASE WHEN e.act = 1 THEN '' ELSE toks[e.pos + 1] END}}) AS r FROM {pre}2),
{pre}4 AS (SELECT doc, toks, list_transform(r, lambda e: {{'draw': e.draw, 'act': e.act, 'pos': e.pos, 'frm': e.frm,
  'to': CASE WHEN e.act = 3 THEN '' ELSE {d_replacement('doc', 'e.frm', 'e.draw')} END}}) AS r FROM {pre}3)"""


def d_plan_ctes(src: str, doc: str) -> str:
    """CTE ``plans(doc, toks, plan)``: of the draws 1 to ``TRIES`` the first k
    that do not change or delete a token again. A draw is such a one if its
    position stands at its own place first (inserts have a key of their own)."""
    key = "CASE WHEN e.act = 1 THEN -e.draw ELSE e.pos END"
    first = (f"list_filter(r, lambda e, i: list_position(list_transform(r, lambda e: {key}), {key}) = i)[1:k]")
    return f"""{d_draw_ctes(src, doc, str(M.TRIES), "t", first)},
plans AS (SELECT doc, toks, CASE WHEN len(toks) = 0 THEN [] ELSE r END AS plan FROM t4)"""


def d_plan_text(p: str) -> str:
    return (f"array_to_string(list_transform({p}, lambda e: e.draw || ':' || e.act || ':' || e.pos || ':' || "
            f"e.frm || ':' || e.\"to\"), ';')")


D_DOC_TOKS = f"dt AS (SELECT doc_id, regexp_extract_all(text, {D_PIECE}, 2) AS toks FROM documents)"


# --- queries ----------------------------------------------------------------------

@register("draw_action", oracle=f"""WITH {D_DOC_TOKS}, {d_draw_ctes('dt', 'doc_id', 'k')}
SELECT doc AS doc_id, array_to_string(list_transform(r, lambda e: e.act), ',') AS acts FROM p4
WHERE len(toks) > 0""")
def q_draw_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: action of every draw (change 5 : insert 1 : delete 4)."""
    d = _docs(spark, sf_dir).where(F.size("toks") > 0).withColumn("_idents", M.identifier_pool(F.col("toks")))
    raw = F.transform(F.sequence(F.lit(1), M.edit_count(SEED, F.col("doc_id"))),
                      lambda i: M.random_edit(F.col("toks"), F.col("_idents"), SEED, F.col("doc_id"), i))
    return d.select("doc_id", F.array_join(F.transform(raw, lambda e: e["act"].cast("string")), ",").alias("acts"))


@register("draw_position", oracle=f"""WITH {D_DOC_TOKS}, {d_draw_ctes('dt', 'doc_id', 'k')}, {D_TOKTAB},
pe AS (SELECT doc, len(toks) AS n, unnest(r) AS e FROM p4 WHERE len(toks) > 0)
SELECT doc AS doc_id, string_agg(CAST(e.pos AS VARCHAR), ',' ORDER BY e.draw) AS positions,
  string_agg(CAST(off + CASE WHEN e.pos = n THEN length(tok) ELSE 0 END AS VARCHAR), ',' ORDER BY e.draw) AS char_positions
FROM pe JOIN tt ON tt.doc_id = doc AND tt.pos = least(e.pos, n - 1) GROUP BY doc""")
def q_draw_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: position of every draw (0..n for inserts, 0..n-1 otherwise), as a
    token number and as a character offset."""
    docs = with_places(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").where(F.size("toks") > 0)
    docs = docs.withColumn("_idents", M.identifier_pool(F.col("toks")))
    raw = F.transform(F.sequence(F.lit(1), M.edit_count(SEED, F.col("doc_id"))),
                      lambda i: M.random_edit(F.col("toks"), F.col("_idents"), SEED, F.col("doc_id"), i))
    docs = docs.withColumn("_at", M.placed(raw, F.col("toks"), F.col("places.off")))
    return docs.select("doc_id", *[F.array_join(F.transform("_at", lambda e: e[c].cast("string")), ",").alias(name)
                                   for c, name in (("pos", "positions"), ("at", "char_positions"))])


@register("random_edit", oracle=f"""WITH {D_DOC_TOKS}, {d_draw_ctes('dt', 'doc_id', 'k')}
SELECT doc AS doc_id, {d_plan_text('[r[1]]')} AS edit FROM p4 WHERE len(toks) > 0""")
def q_random_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the first random edit of each text (action, position, value)."""
    d = _docs(spark, sf_dir).where(F.size("toks") > 0).withColumn("_idents", M.identifier_pool(F.col("toks")))
    e = M.random_edit(F.col("toks"), F.col("_idents"), SEED, F.col("doc_id"), F.lit(1))
    return d.select("doc_id", plan_text(F.array(e)).alias("edit"))


@register("edit_plan", oracle=f"""WITH {D_DOC_TOKS}, {d_plan_ctes('dt', 'doc_id')}
SELECT doc AS doc_id, {d_plan_text('plan')} AS plan FROM plans""")
def q_edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: plan of 1..9 edits per text, one non-insert edit per position; a
    draw that collides is drawn again."""
    d = M.with_edit_plan(_docs(spark, sf_dir), "doc_id", "toks", SEED)
    return d.select("doc_id", plan_text("plan").alias("plan"))


D_ELEMENTS = """el AS (SELECT doc, toks, plan, list_sort(list_concat(
  CASE WHEN len(toks) = 0 THEN [] ELSE list_transform(range(0, len(toks)), lambda p: {'o': 2 * p, 'sub': 0,
    'tok': CASE WHEN len(list_filter(plan, lambda e: e.act <> 1 AND e.pos = p)) = 0 THEN toks[p + 1]
                WHEN list_filter(plan, lambda e: e.act <> 1 AND e.pos = p)[1].act = 4
                THEN list_filter(plan, lambda e: e.act <> 1 AND e.pos = p)[1]."to" END,
    'old': toks[p + 1],
    'kind': coalesce(list_filter(plan, lambda e: e.act <> 1 AND e.pos = p)[1].act, 0)}) END,
  list_transform(list_filter(plan, lambda e: e.act = 1), lambda e: {'o': 2 * e.pos - 1, 'sub': -e.draw,
    'tok': e."to", 'old': '', 'kind': 1}))) AS els FROM plans)"""


@register("apply_edits", oracle=f"""WITH {D_DOC_TOKS}, {d_plan_ctes('dt', 'doc_id')}, {D_ELEMENTS}
SELECT doc AS doc_id, CAST(len(list_filter(els, lambda x: x.kind <> 3)) AS BIGINT) AS n_tokens,
  md5(array_to_string(list_transform(list_filter(els, lambda x: x.kind <> 3), lambda x: x.tok), chr(1))) AS tokens_md5
FROM el""")
def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the corrupted token sequence of every document."""
    d = M.with_applied(M.with_edit_plan(_docs(spark, sf_dir), "doc_id", "toks", SEED), "toks", "plan")
    return d.select("doc_id", F.size("new_toks").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("new_toks", "\u0001")).alias("tokens_md5"))


D_ELEMENT_ROWS = """er AS (SELECT doc, e.o AS o, e.tok AS tok, e.old AS old, e.kind AS kind, i FROM (
  SELECT doc, unnest(els) AS e, generate_subscripts(els, 1) - 1 AS i FROM el))"""


@register("repair_slots", oracle=f"""WITH {D_DOC_TOKS}, {d_plan_ctes('dt', 'doc_id')}, {D_ELEMENTS}, {D_ELEMENT_ROWS},
sl AS (SELECT *, sum(CASE WHEN kind <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS upto,
  coalesce(sum(CASE WHEN kind <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY o
    RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS behind FROM er)
SELECT doc AS doc_id, CAST(CASE WHEN kind = 3 THEN behind ELSE upto END AS BIGINT) AS slot,
  string_agg(CASE kind WHEN 1 THEN '3:' WHEN 4 THEN '4:' || old ELSE '2:' || old END, ';' ORDER BY i DESC) AS actions
FROM sl WHERE kind <> 0 GROUP BY 1, 2""")
def q_repair_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: inverse repair actions per slot of each corrupted document
    (a test takes them back, to the source text)."""
    d = M.with_edit_plan(_docs(spark, sf_dir), "doc_id", "toks", SEED)
    return M.repair_slots(d, "doc_id", "toks", "plan")


@register("misspell", oracle=f"""
SELECT p_partkey, {d_misspell('p_name', 'p_partkey', '1')} AS misspelled FROM part""")
def q_misspell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 on part names."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", M.misspell(F.col("p_name"), SEED, F.col("p_partkey"), F.lit(1)).alias("misspelled"))


# --- job level: offsets, mutators, corrupted text, job, data set ----------------

from repairmine.operators import lines as L  # noqa: E402
from repairmine.operators import sample as T  # noqa: E402
from repairmine.functions.clean import clean_code, is_ascii  # noqa: E402
from repairmine.session import materialize, written_once  # noqa: E402
from repairmine.sources.submissions import dealt_submissions  # noqa: E402


D_NEW_PLACES = """
eb AS (SELECT *, coalesce(sum(CASE kind WHEN 0 THEN 0 WHEN 1 THEN lnew + 2 WHEN 3 THEN 1 - lold
    ELSE 1 - lold + lnew + 2 END) OVER ahead, 0) AS moved,
  coalesce(sum(CASE WHEN kind IN (1, 4) THEN lnew + 1 ELSE 0 END) OVER ahead, 0) AS laid,
  coalesce(min(CASE WHEN kind = 0 THEN i END) OVER (PARTITION BY doc ORDER BY i
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(CASE WHEN kind IN (1, 4) THEN i END) OVER (PARTITION BY doc))
    AS anchor
  FROM (SELECT *, CASE WHEN kind = 1 THEN (o + 1) // 2 ELSE o // 2 END AS p, coalesce(length(tok), 0) AS lnew,
    length(old) AS lold FROM er)
  WINDOW ahead AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
np AS (SELECT x.doc, x.i, x.tok, s.line, s.off + CASE WHEN y.kind <> 0 AND y.p > 0 THEN length(s.tok) + 1 ELSE 0 END
    + y.moved - (y.laid - x.laid) AS off
  FROM eb x JOIN eb y ON y.doc = x.doc AND y.i = x.anchor
  JOIN tt s ON s.doc_id = y.doc AND s.pos = CASE WHEN y.kind = 0 THEN y.p ELSE greatest(y.p - 1, 0) END
  WHERE x.kind <> 3)"""


def with_places(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``toks`` and ``places`` (K1, K4: offset and line) of a text."""
    df = df.withColumns({"toks": K.tokens_of(F.col(text_col)), "_gaps": K.gaps_of(F.col(text_col))})
    return df.withColumn("places", K.row_places(F.col("_gaps"), F.col("toks"))).drop("_gaps")


@register("shift_offsets", oracle=f"""WITH {D_DOC_TOKS}, {d_plan_ctes('dt', 'doc_id')}, {D_ELEMENTS}, {D_ELEMENT_ROWS},
{D_TOKTAB}, {D_NEW_PLACES}
SELECT doc AS doc_id, count(*) AS n_tokens, md5(string_agg(off || ':' || line, ',' ORDER BY i)) AS coords_md5
FROM np GROUP BY doc""")
def q_shift_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: offset and line of every token of each corrupted document."""
    docs = with_places(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    new = M.with_new_tokens(M.with_edit_plan(docs, "doc_id", "toks", SEED), "toks", "plan", "places")

    def told(t):
        coord = F.transform(t, lambda x: F.concat_ws(":", x["off"].cast("string"), x["line"].cast("string")))
        return F.when(F.size(t) > 0, F.array(F.struct(F.size(t).cast("bigint").alias("n_tokens"),
                                                      F.md5(F.array_join(coord, ",")).alias("coords_md5"))))
    # outer: for a plain explode Spark infers a filter on the array and pushes
    # the whole chain below it again
    new = new.select("doc_id", K.bind(F.col("new_tokens"), told).alias("_told"))
    return new.select("doc_id", F.explode_outer("_told").alias("e")).where("e is not null").select("doc_id", "e.*")


def cleaned_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned submissions (C8) with their tokens, written once."""
    def build():
        ty = dealt_submissions(spark, sf_dir).where(
            F.col("problem_name").isNotNull() & F.col("user_id").isNotNull() & F.col("code").isNotNull())
        c = ty.withColumn("problem_user_id", F.concat_ws("_", "problem_name", "user_id")).withColumn(
            "code", clean_code(F.col("code")))
        return c.withColumn("_keep", is_ascii(F.col("code")) & (F.col("code") != ""))
    # written before the filter: a filter on a derived column is otherwise
    # pushed to the scan with the whole cleaning chain inlined into it
    return written_once(spark, "cleaned", [f"{sf_dir}/orders.parquet"], build).where("_keep").drop("_keep")


def passing_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned passing submissions (the corruption input)."""
    return cleaned_submissions(spark, sf_dir).where(F.col("status_code") == 1)


def _mutator_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = passing_code(spark, sf_dir).select("id", K.tokens_of(F.col("code")).alias("toks"))
        src = src.withColumn("_idents", M.identifier_pool(F.col("toks")))
        e = src.withColumn("edits", M.mutator_edits(kind, F.col("toks"), F.col("_idents"), SEED, F.col("id"), F.lit(1)))
        return e.select("id", F.when(F.size("edits") > 0, plan_text("edits")).alias("edits"))
    run.__doc__ = (f"Mutator '{kind}' at a drawn matching position of each passing text (null when the "
                   f"text has no matching position).")
    return run


def d_mutator(kind: str) -> str:
    """The same candidates, drawn position and edits in DuckDB."""
    at = {"identifier": "list_contains(idents, toks[i + 1])", "brace": "toks[i + 1] IN ('{', '}', '(', ')')",
          "brace_pair": "toks[i + 1] = '(' AND toks[i + 2] = ')'", "semicolon": "toks[i + 1] = ';'",
          "return": "toks[i + 1] = 'return'",
          "pointer": "CASE WHEN ins THEN list_contains(idents, toks[i + 1]) ELSE toks[i + 1] IN ('*', '&') END"}[kind]
    cut = "'1:3:' || p || ':' || toks[p + 1] || ':'"
    end = "coalesce(list_min(list_filter(range(0, len(toks)), lambda j: j > p AND toks[j + 1] = ';')), len(toks) - 1)"
    edits = {
        "identifier": f"'1:4:' || p || ':' || toks[p + 1] || ':' || {d_replacement('doc', 'toks[p + 1]', '1')}",
        "brace": cut, "semicolon": cut,
        "brace_pair": f"{cut} || ';1:3:' || (p + 1) || ':' || toks[p + 2] || ':'",
        "return": f"array_to_string(list_transform(range(p, {end} + 1), lambda i: '1:3:' || i || ':' || toks[i + 1] || ':'), ';')",
        "pointer": (f"CASE WHEN ins THEN '1:1:' || p || '::' || CASE WHEN {dd('doc', '1', 'mv')} % 2 = 0 THEN '*' ELSE '&' END "
                    f"ELSE {cut} END")}[kind]
    return f"""WITH {D_SUBT}, {D_CLEAN_CTE},
m0 AS (SELECT id AS doc, regexp_extract_all(code, {D_PIECE}, 2) AS toks FROM cs WHERE status_code = 1),
m1 AS (SELECT doc, toks, {d_idents('toks')} AS idents, {dd('doc', '1', 'mk')} % 2 = 1 AS ins FROM m0),
m2 AS (SELECT *, list_filter(range(0, len(toks)), lambda i: coalesce({at}, false)) AS c FROM m1),
m3 AS (SELECT *, {dpick('c', 'doc', '1', 'mp')} AS p FROM m2)
SELECT doc AS id, CASE WHEN p IS NOT NULL THEN {edits} END AS edits FROM m3"""


for _name, _kind in [("mut_identifier", "identifier"), ("mut_brace", "brace"), ("mut_brace_pair", "brace_pair"),
                     ("mut_semicolon", "semicolon"), ("mut_return", "return"), ("mut_pointer", "pointer")]:
    register(_name, oracle=d_mutator(_kind))(_mutator_query(_kind))


def d_mix_ctes(src: str, doc: str) -> str:
    """CTE ``plans(doc, toks, plan)`` over ``src(doc, toks)`` with all
    mutators, drawn number by number: one recursive step a number, for the
    texts whose plan is not yet full."""
    find = {"identifier": "list_contains(idents, toks[i + 1])", "brace": "toks[i + 1] IN ('{', '}', '(', ')')",
            "brace_pair": "toks[i + 1] = '(' AND toks[i + 2] = ')'", "semicolon": "toks[i + 1] = ';'",
            "return": "toks[i + 1] = 'return'", "pointer": "toks[i + 1] IN ('*', '&')"}
    lists = ", ".join(f"list_filter(range(0, len(toks)), lambda i: coalesce({x}, false)) AS c_{k}" for k, x in find.items())
    act = f"CASE {dweighted(M.ACTION_WEIGHTS, 'doc', 'd', 'a')} WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END"
    ins = f"{dd('doc', 'd', 'mk')} % 2 = 1"
    own = "CASE mut " + " ".join(f"WHEN {j} THEN c_{k}" for j, k in enumerate(M.MUTATORS[1:-1], 1)) + (
        f" ELSE CASE WHEN {ins} THEN c_identifier ELSE c_pointer END END")
    end = "coalesce(list_min(list_filter(c_semicolon, lambda j: j > p)), len(toks) - 1)"
    one = lambda act, pos, frm, to: f"{{'draw': d, 'act': {act}, 'pos': {pos}, 'frm': {frm}, 'to': {to}}}"
    cut = lambda pos: one(3, pos, f"toks[{pos} + 1]", "''")
    sign = f"CASE WHEN {dd('doc', 'd', 'mv')} % 2 = 0 THEN '*' ELSE '&' END"
    return f"""m1 AS MATERIALIZED (SELECT {doc} AS doc, toks, {d_idents('toks')} AS idents, {D_K.format(doc=doc)} AS k FROM {src}),
m2 AS MATERIALIZED (SELECT *, {lists} FROM m1 WHERE len(toks) > 0),
st AS (SELECT doc, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS n, [{{'draw': CAST(0 AS BIGINT), 'act': 0, 'pos': CAST(0 AS BIGINT),
    'frm': '', 'to': ''}}][2:] AS plan FROM m2
  UNION ALL
  SELECT doc, d, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_concat(plan, es) ELSE plan END FROM (
    SELECT *, len(es) > 0 AND NOT list_has_any(
      list_transform(list_filter(plan, lambda x: x.act <> 1), lambda x: x.pos),
      list_transform(list_filter(es, lambda x: x.act <> 1), lambda x: x.pos)) AS ok FROM (
    SELECT *, CASE WHEN p IS NULL THEN [] WHEN mut = 0 THEN [{one('act', 'p', 'frm', "CASE WHEN act = 3 THEN '' ELSE " + d_replacement('doc', 'frm', 'd') + " END")}]
      WHEN mut = 1 THEN [{one(4, 'p', 'frm', d_replacement('doc', 'frm', 'd'))}]
      WHEN mut = 3 THEN [{cut('p')}, {cut('(p + 1)')}]
      WHEN mut = 5 THEN list_transform(range(p, {end} + 1), lambda i: {cut('i')})
      WHEN mut = 6 AND {ins} THEN [{one(1, 'p', "''", sign)}] ELSE [{cut('p')}] END AS es FROM (
    SELECT *, CASE WHEN mut = 0 AND act = 1 THEN '' ELSE toks[p + 1] END AS frm FROM (
    SELECT *, CASE WHEN mut = 0 THEN {dd('doc', 'd', 'p')} % (len(toks) + CASE WHEN act = 1 THEN 1 ELSE 0 END)
      ELSE {dpick('c', 'doc', 'd', 'mp')} END AS p FROM (
    SELECT *, {own} AS c FROM (
    SELECT *, {dweighted(M.ALL_MUTATOR_WEIGHTS, 'doc', 'd', 'mut')} AS mut, {act} AS act FROM (
    SELECT st.d + 1 AS d, st.n, st.plan, m2.* FROM st JOIN m2 USING (doc) WHERE st.n < m2.k AND st.d < {M.TRIES})))))))),
plans AS (SELECT m1.doc, m1.toks, coalesce(f.plan, []) AS plan
  FROM m1 LEFT JOIN (SELECT doc, arg_max(plan, d) AS plan FROM st GROUP BY doc) f ON f.doc = m1.doc)"""


@register("mutator_mix", oracle=f"""WITH RECURSIVE {D_SUBT}, {D_CLEAN_CTE},
m0 AS (SELECT id, regexp_extract_all(code, {D_PIECE}, 2) AS toks FROM cs WHERE status_code = 1), {d_mix_ctes('m0', 'id')}
SELECT doc AS id, CAST(len(plan) AS BIGINT) AS n_edits, {d_plan_text('plan')} AS plan FROM plans""")
def q_mutator_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per draw, a mutator chosen by the weights of all seven; a draw
    whose mutator finds no position, or collides, is drawn again."""
    src = passing_code(spark, sf_dir).select("id", K.tokens_of(F.col("code")).alias("toks"))
    planned = M.with_edit_plan(src, "id", "toks", SEED, weights=M.ALL_MUTATOR_WEIGHTS)
    return planned.select("id", F.size("plan").cast("bigint").alias("n_edits"), plan_text("plan").alias("plan"))


def corrupt_texts(src: DataFrame, id_col: str, code_col: str, seed=SEED, weights=M.RANDOM_ONLY) -> DataFrame:
    """Reference lines blanked (L4) -> tokens with offsets (K1, K4) ->
    plan (M6) with character offsets (M2) -> new tokens (M7) and offsets (M9)
    -> text (K5), all in the row -> reference lines put back on their line
    numbers (L7). Texts without tokens have no plan and are skipped, and so
    are texts that lose every token; no text is too long. Output ``id, plan,
    text, conflicts``."""
    blanked = with_places(src.select(id_col, L.blank_ref_lines(F.col(code_col)).alias("_blank")), "_blank")
    new = M.with_new_tokens(M.with_edit_plan(blanked, id_col, "toks", seed, weights=weights), "toks", "plan", "places")
    made = materialize(src.sparkSession, new.select(
        id_col, M.placed(F.col("plan"), F.col("toks"), F.col("places.off")).alias("plan"),
        F.size("new_tokens").alias("_n"), K.text_of(F.col("new_tokens")).alias("text")), "corrupted")
    made = made.where((F.size("plan") > 0) & (F.col("_n") > 0))
    saved = L.ref_line_numbers(src, id_col, code_col).select(id_col, "line_no", "line")
    return made.select(id_col, "plan").join(L.restore_lines(made.select(id_col, "text"), saved, id_col, "text"), id_col)


def d_corrupted(plan_ctes=d_plan_ctes) -> str:
    """CTEs ``plans`` and ``made(doc, text, conflicts)`` of the passing submissions."""
    return f"""{D_SUBT}, {D_CLEAN_CTE}, ps AS (SELECT * FROM cs WHERE status_code = 1), {d_ref_line_no('ps')},
bk AS (SELECT id AS doc_id, array_to_string(list_transform({d(D_LINES, 'code')},
  lambda l: CASE WHEN regexp_matches(l, {D_REF}) THEN '' ELSE l END), chr(10)) AS text FROM ps),
bt AS (SELECT doc_id, regexp_extract_all(text, {D_PIECE}, 2) AS toks FROM bk),
{plan_ctes('bt', 'doc_id')}, {D_ELEMENTS}, {D_ELEMENT_ROWS}, {D_TOKTAB.replace('FROM documents', 'FROM bk')}, {D_NEW_PLACES},
nz AS (SELECT *, line - coalesce(lag(line) OVER w, 1) AS nl, off - coalesce(lag(off) OVER w, 0) AS doff,
  coalesce(lag(length(tok)) OVER w, 0) AS plen FROM np WINDOW w AS (PARTITION BY doc ORDER BY i)),
nt AS (SELECT doc, string_agg(repeat(chr(10), CAST(greatest(nl, 0) AS BIGINT)) || repeat(' ', CAST(greatest(
  doff - CASE WHEN nl <> 0 THEN nl + 1 ELSE plen END, 0) AS BIGINT)) || tok, '' ORDER BY i) AS text FROM nz GROUP BY doc),
nl AS (SELECT doc, unnest({d(D_LINES, 'text')}) AS cur, generate_subscripts({d(D_LINES, 'text')}, 1) - 1 AS n FROM nt),
nj AS (SELECT nl.doc, n, cur, rl.line, rl.line IS NOT NULL AND {d(D_STRIP, 'cur')} = '' AS fits
  FROM nl LEFT JOIN rl ON rl.id = nl.doc AND rl.line_no = n),
made AS (SELECT doc, string_agg(CASE WHEN fits THEN line ELSE cur END, chr(10) ORDER BY n) AS text,
  coalesce(any_value(t.saved), 0) - count(CASE WHEN fits THEN 1 END) AS conflicts
  FROM nj LEFT JOIN (SELECT id, count(*) AS saved FROM rl GROUP BY id) t ON t.id = doc GROUP BY doc)"""


@register("corrupt_text", oracle=f"""WITH {d_corrupted()}
SELECT plans.doc AS id, CAST(len(plan) AS BIGINT) AS n_edits, text, CAST(conflicts AS BIGINT) AS conflicts
FROM plans JOIN made ON made.doc = plans.doc WHERE len(plan) > 0""")
def q_corrupt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 on the passing submissions."""
    c = corrupt_texts(passing_code(spark, sf_dir), "id", "code")
    return c.select("id", F.size("plan").cast("bigint").alias("n_edits"), "text",
                    F.col("conflicts").cast("bigint").alias("conflicts"))


def corruption_job(spark: SparkSession, sf_dir: str, done: DataFrame | None = None,
                   weights=M.RANDOM_ONLY) -> DataFrame:
    """Passing rows of users without a compile failure (J2) ->
    skip keys already done (J3) -> corrupt (M17) -> records with the edit
    list as JSON text (character offset and token position of every edit) and
    the edit count as distance."""
    src = passing_code(spark, sf_dir)
    allrows = cleaned_submissions(spark, sf_dir)
    failing = allrows.where(F.col("status_code") == 7).select("user_id").distinct()
    src = src.join(failing, "user_id", "left_anti")
    if done is not None:
        src = src.join(done.select("problem_user_id").distinct(), "problem_user_id", "left_anti")
    c = corrupt_texts(src, "id", "code", weights=weights)
    acts_json = F.to_json(F.transform("plan", lambda x: F.struct(
        x["act"].alias("act_type"), x["frm"].alias("from_char"), x["to"].alias("to_char"),
        x["at"].alias("ac_pos"), x["pos"].alias("token_pos"))))
    return src.join(c, "id").select(
        "id", F.lit(None).cast("string").alias("submit_url"), F.col("problem_name").alias("problem_id"),
        "user_id", "problem_user_id", F.col("text").alias("code"), F.col("code").alias("similar_code"),
        acts_json.alias("modify_action_list"), F.size("plan").cast("int").alias("distance"))


@register("corruption_job", oracle=f"""WITH {d_corrupted()},
pa AS (SELECT p.doc, e.draw AS draw, {{'act_type': e.act, 'from_char': e.frm, 'to_char': e."to",
    'ac_pos': tt.off + CASE WHEN e.pos = n THEN length(tt.tok) ELSE 0 END, 'token_pos': e.pos}} AS a
  FROM (SELECT doc, len(toks) AS n, unnest(plan) AS e FROM plans) p
  JOIN tt ON tt.doc_id = p.doc AND tt.pos = least(e.pos, n - 1)),
pj AS (SELECT doc, CAST(to_json(list(a ORDER BY draw)) AS VARCHAR) AS acts, count(*) AS n FROM pa GROUP BY doc)
SELECT ps.id, CAST(NULL AS VARCHAR) AS submit_url, problem_name AS problem_id, user_id,
  problem_name || '_' || user_id AS problem_user_id, made.text AS code, ps.code AS similar_code,
  pj.acts AS modify_action_list, CAST(pj.n AS INTEGER) AS distance
FROM ps JOIN made ON made.doc = ps.id JOIN pj ON pj.doc = ps.id
WHERE NOT EXISTS (SELECT 1 FROM cs f WHERE f.status_code = 7 AND f.user_id = ps.user_id)""")
def q_corruption_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 on the cleaned submissions."""
    return corruption_job(spark, sf_dir)


def build_dataset(spark: SparkSession, sf_dir: str, weights) -> DataFrame:
    """test = real failures with 0 < d < 10, one per problem-user; train /
    valid = synthetic rows with 0 < d < 10, one per problem-user, valid = 10 %
    of the users. ``weights`` of the mutators tell the two variants apart."""
    from repairmine.plans.mining import mine_compile_errors

    def one_each(rows: DataFrame) -> DataFrame:
        rows = rows.where((F.col("distance") > 0) & (F.col("distance") < 10))
        return T.cap_per_key(rows.select("id", "problem_user_id", "user_id"), ["problem_user_id"], 1, SEED)
    real = one_each(mine_compile_errors(spark, sf_dir))
    fake = materialize(spark, one_each(corruption_job(spark, sf_dir, weights=weights)), "synthetic")
    valid_users = T.holdout_keys(fake, "user_id", 0.1, SEED)
    fake = T.split_by_keys(fake, "user_id", valid_users, "valid", "train")
    return (real.withColumn("split", F.lit("test")).withColumn("source", F.lit("real"))
            .unionByName(fake.withColumn("source", F.lit("synthetic"))))


def d_build_dataset(plan_ctes) -> str:
    from repairmine.plans.mining import D_MINE_COMPILE, d_with_scripts
    from repairmine.plans.relational import d_cap, d_first_k
    cols = "id, problem_user_id, user_id"
    return f"""WITH re AS ({D_MINE_COMPILE}{d_with_scripts('SELECT id, problem_user_id, distance FROM w')}),
ru AS (WITH {D_SUBT} SELECT re.*, subt.user_id FROM re JOIN subt ON subt.id = re.id WHERE distance > 0 AND distance < 10),
fa AS (WITH RECURSIVE {d_corrupted(plan_ctes)}
  SELECT ps.id, problem_name || '_' || user_id AS problem_user_id, user_id
  FROM ps JOIN made ON made.doc = ps.id JOIN plans ON plans.doc = ps.id
  WHERE len(plan) BETWEEN 1 AND 9 AND NOT EXISTS (SELECT 1 FROM cs f WHERE f.status_code = 7 AND f.user_id = ps.user_id)),
f1 AS ({d_cap('fa', 'problem_user_id', 'id', 1, cols, SEED)}), va AS ({d_first_k('f1', 'user_id', 0.1, SEED)})
SELECT {cols}, 'test' AS split, 'real' AS source FROM ({d_cap('ru', 'problem_user_id', 'id', 1, cols, SEED)})
UNION ALL
SELECT {cols}, CASE WHEN user_id IN (SELECT user_id FROM va) THEN 'valid' ELSE 'train' END, 'synthetic' FROM f1"""


@register("build_dataset", oracle=d_build_dataset(d_plan_ctes))
def q_build_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 with synthetic rows of the random mutator."""
    return build_dataset(spark, sf_dir, M.RANDOM_ONLY)


@register("build_dataset_mix", oracle=d_build_dataset(d_mix_ctes))
def q_build_dataset_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 with synthetic rows of all mutators by weight."""
    return build_dataset(spark, sf_dir, M.ALL_MUTATOR_WEIGHTS)


@register("draw_replacement", oracle=f"""WITH {D_SUBT}, {D_CLEAN_CTE},
st AS (SELECT id, regexp_extract_all(code, {D_PIECE}, 2) AS toks FROM cs WHERE status_code = 1),
{d_draw_ctes('st', 'id', 'k')}
SELECT doc AS id, {d_plan_text('r')} AS draws FROM p4 WHERE len(toks) > 0""")
def q_draw_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: replacement value of every draw on the passing submissions (other
    word of the same class 4 : misspelling 1; classes 1 : 3 : 6)."""
    src = passing_code(spark, sf_dir).select("id", K.tokens_of(F.col("code")).alias("toks")).where(F.size("toks") > 0)
    src = src.withColumn("_idents", M.identifier_pool(F.col("toks")))
    raw = F.transform(F.sequence(F.lit(1), M.edit_count(SEED, F.col("id"))),
                      lambda i: M.random_edit(F.col("toks"), F.col("_idents"), SEED, F.col("id"), i))
    return src.select("id", plan_text(raw).alias("draws"))
