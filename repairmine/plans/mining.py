"""Mining jobs on submissions: nearest passing text for each failing text,
edit scripts, result records (D1-D10, J4, A7, A8, S13, S14, P10, P11, F2, T9).

Plan of one job (one lazy DataFrame; nothing is collected):
  typed read -> clean (C8) -> tokens (K1, C9 rule) -> reference names (L2)
  -> token ids (corpus-wide) -> groups with both sides (semi join) -> joins
  on (group, refs, profile cells) -> banded levenshtein -> arg-min per failing
  text (hash aggregate) -> matrix and trace-back on the winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions import clean as C
from repairmine.functions.dicts import (COMPILE_FAIL_CODES, KEEP_FOR_TEST_MINING, LANGUAGE, PASS_CODES,
                                        PASS_OR_WRONG, TEST_FAIL_CODES, VERDICT, decode)
from repairmine.functions.hashing import md5_mod
from repairmine.operators import lines as L
from repairmine.operators import tokens as K
from repairmine.operators.distance import nearest_partner, token_distance, token_ids
from repairmine.operators.edits import DELETE, apply_sql, build_actions, script_text, with_script_arrow
from repairmine.plans.registry import register
from repairmine.plans.relational import groups_with_both
from repairmine.plans.sqltext import d_matrix, d_script, d_script_text, q
from repairmine.plans.text import D_CLEAN_CTE, D_PIECE, D_SUBT, clean_corpus, d_drop_ref_lines, d_ref_lines, d_ref_name
from repairmine.session import ensure_checkpoint_dir, materialize, written_once
from repairmine.sources.submissions import dealt, dealt_submissions

TEST_BOUND = 101          # D9: keep 0 <= d < 101
SCRIPTS_A_TASK = 2000     # pairs of one task that makes scripts
CHUNK_ROWS = 100          # S11: rows per chunk of the success job
CHUNK_BUCKETS = 64
GROUP = ["problem_user_id", "refs"]
COMPILE, TEST = "compile", "test"


def tokenized(cs: DataFrame) -> DataFrame:
    """K1 + L2: token arrays and reference-name key of each cleaned text, of
    any length. The compile-failure job (``toks_compile``) tokenizes the text
    without its reference lines; the test-failure job (``toks_test``) keeps
    them, and gives no tokens to texts with preprocessor words (C9)."""
    code = F.col("code")
    return (cs.withColumn(f"toks_{COMPILE}", K.tokens_of(L.drop_ref_lines(code)))
            .withColumn(f"toks_{TEST}", F.when(~C.has_directive(code), K.tokens_of(code)))
            .withColumn("refs", F.array_join(L.ref_names(code), "\u0001")))


def mining_corpus(spark: SparkSession, sf_dir: str, job: str = COMPILE, key=None) -> DataFrame:
    """Cleaned, tokenized submissions of a job, with ``seq``, the ids of their
    tokens (of the values that ``key`` compares, U1).

    Both jobs, and every branch of a job (both sides of the search, its
    rounds, the partner join), read one corpus: it is written as a parquet
    table in the shared ``spark.checkpoint.dir`` and reused while the input's
    files stay the same.
    """
    ensure_checkpoint_dir(spark)

    def cleaned():
        # one pass of the regex work, written before any filter, so the
        # cleaning is not evaluated again inside a pushed-down predicate
        ty = dealt_submissions(spark, sf_dir).where(
            F.col("problem_name").isNotNull() & F.col("user_id").isNotNull() & F.col("code").isNotNull())
        c = ty.withColumn("problem_user_id", F.concat_ws("_", "problem_name", "user_id")).withColumn(
            "code", C.clean_code(F.col("code")))
        t = tokenized(c).withColumn("_keep", C.is_ascii(F.col("code")) & (F.col("code") != ""))
        return t.withColumns({f"seq_{j}": token_ids(F.col(f"toks_{j}")) for j in (COMPILE, TEST)})

    both = written_once(spark, "tokenized", [f"{sf_dir}/orders.parquet"], cleaned).where("_keep")
    own = both.withColumn("toks", F.col(f"toks_{job}")).withColumn(
        "seq", F.col(f"seq_{job}") if key is None else token_ids(F.col("toks"), key))
    return own.drop("_keep", *[f"{c}_{j}" for c in ("toks", "seq") for j in (COMPILE, TEST)])


def nearest(corpus: DataFrame, fail_codes, pass_codes, bound: int | None, groups: DataFrame | None = None) -> DataFrame:
    """D4 on the corpus: failing rows (of ``groups``) with their nearest
    passing row. The groups are kept afterwards: rows that meet them first lie
    in one task a problem-user, and their copies would be collapsed there."""
    fail = corpus.where(F.col("status_code").isin(*fail_codes))
    ok = corpus.where(F.col("status_code").isin(*pass_codes)).select("id", *GROUP, "seq")
    near = nearest_partner(fail, ok, GROUP, id_col="id", seq_col="seq", max_distance=bound, pair_col="pair")
    return near if groups is None else near.join(groups, "problem_user_id", "left_semi")


def with_scripts(near: DataFrame, corpus: DataFrame) -> DataFrame:
    """D3 + D5 + D6 on the winners: ``near`` with the partner's code, script
    and applied script. Copies of a group share a ``pair``; partners are
    fetched and scripts made once a pair, and rows only carry its number."""
    spark = near.sparkSession
    near = materialize(spark, near, "nearest")
    found = near.where(F.col("distance") >= 0)
    pairs = materialize(spark, found.select("pair", "similar_id", "seq", "similar_seq", "distance", "toks").distinct(), "pairs")
    partners = materialize(spark, pairs.select("similar_id").distinct(), "partners")
    part = corpus.select(F.col("id").alias("similar_id"), F.col("toks").alias("similar_toks"),
                         F.col("code").alias("similar_code")).join(partners, "similar_id", "left_semi")
    met = materialize(spark, pairs.hint("merge").join(part, "similar_id"), "partnered")
    each = dealt(met.drop("similar_id", "similar_code").distinct(), SCRIPTS_A_TASK)
    scripts = with_script_arrow(each, "seq", "similar_seq", "toks", "similar_toks", distance="distance").withColumn(
        "applied", F.expr(apply_sql("similar_toks", "acts")))
    made = met.select("pair", "similar_code").join(scripts.select("pair", "acts", "applied").hint("merge"), "pair")
    # an id that repeats meets the scripts of all its rows
    of_id = found.select("id", F.col("pair").alias("_made"))
    return near.join(of_id.hint("merge"), "id", "left").join(
        made.withColumnRenamed("pair", "_made").hint("merge"), "_made", "left").drop("_made", "pair")


def mine_compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a pass and a compile failure -> unbounded nearest ->
    scripts. Failing rows without a partner keep distance -1."""
    corpus = mining_corpus(spark, sf_dir)
    both = groups_with_both(corpus, PASS_CODES, COMPILE_FAIL_CODES)
    c = corpus.join(both, "problem_user_id", "left_semi")
    return with_scripts(nearest(corpus, COMPILE_FAIL_CODES, PASS_CODES, None, both), c)


def mine_test_errors(spark: SparkSession, sf_dir: str, done: DataFrame | None = None) -> DataFrame:
    """Verdicts {1,3,4,5,6} -> skip keys already done (J3) -> groups with
    a pass and a test failure (A3) -> nearest with bound 101 -> scripts."""
    corpus = mining_corpus(spark, sf_dir, TEST).where(F.col("status_code").isin(*KEEP_FOR_TEST_MINING))
    if done is not None:
        corpus = corpus.join(done.select("problem_user_id").distinct(), "problem_user_id", "left_anti")
    both = groups_with_both(corpus, PASS_CODES, TEST_FAIL_CODES)
    c = corpus.join(both, "problem_user_id", "left_semi")
    return with_scripts(nearest(corpus, TEST_FAIL_CODES, PASS_CODES, TEST_BOUND, both), c)


def mined_columns(compile_result: int) -> dict:
    """The columns of a result-table record; rows without a
    partner get ``('', '', -1)`` in the result columns."""
    found = F.col("distance") >= 0
    return {
        "id": F.col("id"), "submit_url": F.lit(None).cast("string"), "problem_id": F.col("problem_name"),
        "user_id": F.col("user_id"), "problem_user_id": F.col("problem_user_id"), "code": F.col("code"),
        "gcc_compile_result": F.lit(compile_result),
        "similar_code": F.when(found, F.col("similar_code")).otherwise(F.lit("")),
        "modify_action_list": F.when(found, F.to_json(build_actions(F.col("acts")))).otherwise(F.lit("")),
        "distance": F.when(found, F.col("distance")).otherwise(F.lit(-1)).cast("int")}


def mined_record(df: DataFrame, compile_result: int, columns=mined_columns) -> DataFrame:
    """U4: mined rows -> records by a mapping from column name to expression."""
    return df.select(*[c.alias(n) for n, c in columns(compile_result).items()])


# ----------------------------------------------------------------------------
# DuckDB oracle pieces: the same corpus with ASCII symbols (<= 94 tokens per
# problem-user in these tables), pair join, arg-min, scripts.

D_DIRECTIVE = " OR ".join(f"instr(code, {q(w)}) > 0" for w in C.DIRECTIVE_WORDS)
D_JOB_TOKENS = {
    COMPILE: f"regexp_extract_all({d_drop_ref_lines('code')}, {D_PIECE}, 2)",
    TEST: f"CASE WHEN NOT ({D_DIRECTIVE}) THEN regexp_extract_all(code, {D_PIECE}, 2) END"}


def d_corpus(job: str) -> str:
    return f"""{D_SUBT}, {D_CLEAN_CTE},
tk AS (SELECT id, problem_name, user_id, problem_user_id, status_code, language, code,
  array_to_string(list_transform({d_ref_lines('code')}, lambda x: {d_ref_name('x')}), chr(1)) AS refs,
  {D_JOB_TOKENS[job]} AS toks FROM cs),
ut AS (SELECT id, problem_user_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM tk WHERE toks IS NOT NULL),
vb AS (SELECT problem_user_id, tok, dense_rank() OVER (PARTITION BY problem_user_id ORDER BY tok) AS r
  FROM (SELECT DISTINCT problem_user_id, tok FROM ut)),
sq AS (SELECT ut.id, string_agg(chr(CAST(32 + vb.r AS INTEGER)), '' ORDER BY ut.p) AS seq
  FROM ut JOIN vb ON ut.problem_user_id = vb.problem_user_id AND ut.tok = vb.tok GROUP BY ut.id),
corpus AS (SELECT tk.*, CASE WHEN tk.toks IS NULL THEN NULL WHEN len(tk.toks) = 0 THEN '' ELSE sq.seq END AS seq
  FROM tk LEFT JOIN sq ON tk.id = sq.id)"""


D_CORPUS = d_corpus(COMPILE)


def d_both(src: str, ok: str, err: str) -> str:
    return (f"(SELECT problem_user_id FROM {src} GROUP BY problem_user_id "
            f"HAVING bool_or(status_code IN ({ok})) AND bool_or(status_code IN ({err})))")


def d_nearest(src: str, fail: str, ok: str, bound: int | None) -> str:
    """CTEs ``f`` (failing rows) and ``nb`` (nearest per failing row)."""
    cut = f"AND d < {bound}" if bound else ""
    return f"""f AS (SELECT * FROM {src} WHERE status_code IN ({fail})),
p AS (SELECT * FROM {src} WHERE status_code IN ({ok}) AND seq IS NOT NULL),
pr AS (SELECT f.id, p.id AS similar_id, levenshtein(f.seq, p.seq) AS d FROM f JOIN p
  ON f.problem_user_id = p.problem_user_id AND f.refs = p.refs WHERE f.seq IS NOT NULL),
nb AS (SELECT id, similar_id, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, similar_id) AS rn
  FROM pr WHERE d >= 0 {cut}) WHERE rn = 1)"""


def _codes(t) -> str:
    return ", ".join(str(x) for x in t)


D_MINE_COMPILE = (f"WITH {D_CORPUS}, c AS (SELECT * FROM corpus WHERE problem_user_id IN "
                  f"{d_both('corpus', _codes(PASS_CODES), _codes(COMPILE_FAIL_CODES))}), "
                  + d_nearest("c", _codes(COMPILE_FAIL_CODES), _codes(PASS_CODES), None))
D_MINE_TEST = (f"WITH {d_corpus(TEST)}, k AS (SELECT * FROM corpus WHERE status_code IN ({_codes(KEEP_FOR_TEST_MINING)})), "
               f"c AS (SELECT * FROM k WHERE problem_user_id IN "
               f"{d_both('k', _codes(PASS_CODES), _codes(TEST_FAIL_CODES))}), "
               + d_nearest("c", _codes(TEST_FAIL_CODES), _codes(PASS_CODES), TEST_BOUND))
D_SCRIPT_OF = d_script_text(d_script("mat", "a", "b", lambda i: f"ta[{i}]", lambda j: f"tb[{j}]"))


def d_with_scripts(tail: str) -> str:
    return f""", w AS (SELECT f.id, f.problem_user_id, nb.similar_id, CAST(coalesce(nb.d, -1) AS BIGINT) AS distance,
  f.seq AS a, s.seq AS b, f.toks AS ta, s.toks AS tb, s.code AS similar_code
  FROM f LEFT JOIN nb ON f.id = nb.id LEFT JOIN c s ON s.id = nb.similar_id),
ws AS (SELECT *, CASE WHEN distance >= 0 THEN {d_matrix('a', 'b')} END AS mat FROM w)
{tail}"""


# ----------------------------------------------------------------------------

@register("token_distance", oracle=f"""WITH {D_CORPUS},
r AS (SELECT problem_user_id, refs, min(id) AS rid FROM corpus WHERE status_code = 1 AND seq IS NOT NULL
  GROUP BY problem_user_id, refs)
SELECT f.id, r.rid AS ref_id, CAST(levenshtein(f.seq, p.seq) AS BIGINT) AS distance
FROM corpus f JOIN r ON f.problem_user_id = r.problem_user_id AND f.refs = r.refs JOIN corpus p ON p.id = r.rid
WHERE f.status_code = 7 AND f.seq IS NOT NULL""")
def q_token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token distance of every failing text to the reference passing
    text of its group (the passing text with the smallest id)."""
    c = mining_corpus(spark, sf_dir)
    ref = (c.where((F.col("status_code") == 1) & F.col("seq").isNotNull())
           .groupBy(*GROUP).agg(F.min("id").alias("ref_id")))
    rs = c.select(F.col("id").alias("ref_id"), F.col("seq").alias("ref_seq"))
    f = c.where((F.col("status_code") == 7) & F.col("seq").isNotNull()).join(ref, GROUP).join(rs, "ref_id")
    return f.select("id", "ref_id", token_distance(F.col("seq"), F.col("ref_seq")).cast("bigint").alias("distance"))


def _digits(t):
    return F.regexp_replace(t, "[0-9]+", "0")


@register("token_distance_keyed", oracle=f"""WITH {D_CORPUS.replace(
    'dense_rank() OVER (PARTITION BY problem_user_id ORDER BY tok) AS r', "dense_rank() OVER (PARTITION BY "
    "problem_user_id ORDER BY regexp_replace(tok, '[0-9]+', '0', 'g')) AS r")},
r AS (SELECT problem_user_id, refs, min(id) AS rid FROM corpus WHERE status_code = 1 AND seq IS NOT NULL
  GROUP BY problem_user_id, refs)
SELECT f.id, r.rid AS ref_id, CAST(levenshtein(f.seq, p.seq) AS BIGINT) AS distance
FROM corpus f JOIN r ON f.problem_user_id = r.problem_user_id AND f.refs = r.refs JOIN corpus p ON p.id = r.rid
WHERE f.status_code = 7 AND f.seq IS NOT NULL""")
def q_token_distance_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same distance with a pluggable token key (all numbers equal)."""
    c = mining_corpus(spark, sf_dir, COMPILE, key=_digits)
    ref = (c.where((F.col("status_code") == 1) & F.col("seq").isNotNull())
           .groupBy(*GROUP).agg(F.min("id").alias("ref_id")))
    rs = c.select(F.col("id").alias("ref_id"), F.col("seq").alias("ref_seq"))
    f = c.where((F.col("status_code") == 7) & F.col("seq").isNotNull()).join(ref, GROUP).join(rs, "ref_id")
    return f.select("id", "ref_id", token_distance(F.col("seq"), F.col("ref_seq")).cast("bigint").alias("distance"))


@register("bounded_distance", oracle=f"""WITH {D_CORPUS},
r AS (SELECT problem_user_id, refs, min(id) AS rid FROM corpus WHERE status_code = 1 AND seq IS NOT NULL
  GROUP BY problem_user_id, refs)
SELECT f.id, r.rid AS ref_id,
  CAST(CASE WHEN levenshtein(f.seq, p.seq) > 3 THEN -1 ELSE levenshtein(f.seq, p.seq) END AS BIGINT) AS distance
FROM corpus f JOIN r ON f.problem_user_id = r.problem_user_id AND f.refs = r.refs JOIN corpus p ON p.id = r.rid
WHERE f.status_code = 7 AND f.seq IS NOT NULL""")
def q_bounded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded distance (-1 above 3)."""
    c = mining_corpus(spark, sf_dir)
    ref = (c.where((F.col("status_code") == 1) & F.col("seq").isNotNull())
           .groupBy(*GROUP).agg(F.min("id").alias("ref_id")))
    rs = c.select(F.col("id").alias("ref_id"), F.col("seq").alias("ref_seq"))
    f = c.where((F.col("status_code") == 7) & F.col("seq").isNotNull()).join(ref, GROUP).join(rs, "ref_id")
    return f.select("id", "ref_id", token_distance(F.col("seq"), F.col("ref_seq"), 3).cast("bigint").alias("distance"))


@register("candidate_pairs", oracle=f"""WITH {D_CORPUS}
SELECT f.id, CAST(count(p.id) AS BIGINT) AS n_candidates FROM corpus f LEFT JOIN corpus p
  ON f.problem_user_id = p.problem_user_id AND f.refs = p.refs AND p.status_code = 1 AND p.seq IS NOT NULL
  AND abs(length(f.seq) - length(p.seq)) <= 2
WHERE f.status_code = 7 AND f.seq IS NOT NULL GROUP BY f.id""")
def q_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of candidate partners of each failing text (same group and
    references, length within 2), counted from a length histogram of the
    passing side, so no pair rows are formed."""
    c = mining_corpus(spark, sf_dir)
    hist = (c.where((F.col("status_code") == 1) & F.col("seq").isNotNull())
            .groupBy(*GROUP, F.size("seq").alias("lb")).agg(F.count("*").alias("cnt")))
    f = c.where((F.col("status_code") == 7) & F.col("seq").isNotNull()).select("id", *GROUP,
                                                                                F.size("seq").alias("la"))
    j = f.join(hist, [*GROUP], "left").where(F.col("lb").isNull() | (F.abs(F.col("la") - F.col("lb")) <= 2))
    n = j.groupBy("id").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("n"))
    return (f.select("id").join(n, "id", "left")
            .select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates")))


@register("nearest_text", oracle=f"""WITH {D_CORPUS}, c AS (SELECT * FROM corpus),
{d_nearest("c", "7", "1", None)}
SELECT f.id, nb.similar_id, CAST(coalesce(nb.d, -1) AS BIGINT) AS distance FROM f LEFT JOIN nb ON f.id = nb.id""")
def q_nearest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest passing text of every compile failure, at any distance."""
    near = nearest(mining_corpus(spark, sf_dir), COMPILE_FAIL_CODES, PASS_CODES, None)
    return near.select("id", "similar_id", F.col("distance").cast("bigint").alias("distance"))


@register("mine_compile_errors", oracle=D_MINE_COMPILE + d_with_scripts(f"""
SELECT id, problem_user_id, similar_id, distance,
  CASE WHEN distance >= 0 THEN {D_SCRIPT_OF.replace('mat', 'mat')} END AS script FROM ws"""))
def q_mine_compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compile failures with nearest passing text and edit script."""
    m = mine_compile_errors(spark, sf_dir)
    return m.select("id", "problem_user_id", "similar_id", F.col("distance").cast("bigint").alias("distance"),
                    F.when(F.col("distance") >= 0, script_text(F.col("acts"))).alias("script"))


@register("mine_test_errors", oracle=D_MINE_TEST + d_with_scripts(f"""
SELECT id, problem_user_id, similar_id, distance,
  CASE WHEN distance >= 0 THEN {D_SCRIPT_OF} END AS script FROM ws"""))
def q_mine_test_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-case failures (bound 101), fresh run (no keys done)."""
    m = mine_test_errors(spark, sf_dir)
    return m.select("id", "problem_user_id", "similar_id", F.col("distance").cast("bigint").alias("distance"),
                    F.when(F.col("distance") >= 0, script_text(F.col("acts"))).alias("script"))


@register("apply_script", oracle=D_MINE_COMPILE + d_with_scripts("""
SELECT id, array_to_string(ta, chr(1)) AS applied FROM ws WHERE distance >= 0"""))
def q_apply_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying each mined script to the partner's tokens."""
    m = mine_compile_errors(spark, sf_dir).where(F.col("distance") >= 0)
    return m.select("id", F.array_join("applied", "\u0001").alias("applied"))


D_ACTS_JSON = ("CAST(to_json(list_transform(acts, lambda x: {'act_type': x.act, 'from_char': x.frm, "
               "'to_char': x.\"to\", 'token_pos': x.pos})) AS VARCHAR)")
D_RECORDS = D_MINE_COMPILE + d_with_scripts(f"""
, sc AS (SELECT *, CASE WHEN distance >= 0 THEN {d_script("mat", "a", "b", lambda i: f"ta[{i}]", lambda j: f"tb[{j}]")} END
  AS acts FROM ws),
records AS (SELECT sc.id, NULL::VARCHAR AS submit_url, f.problem_name AS problem_id, f.user_id, sc.problem_user_id, f.code,
  0 AS gcc_compile_result, CASE WHEN distance >= 0 THEN similar_code ELSE '' END AS similar_code,
  CASE WHEN distance >= 0 THEN {D_ACTS_JSON} ELSE '' END AS modify_action_list, CAST(distance AS INTEGER) AS distance
  FROM sc JOIN f ON f.id = sc.id)""")


@register("mined_records", oracle=D_RECORDS + " SELECT * FROM records")
def q_mined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 (+P9, P10): compile-failure records in the result-table shape,
    edit lists as JSON text."""
    return mined_record(mine_compile_errors(spark, sf_dir), 0)


@register("edits_json", oracle=D_RECORDS + """
SELECT id, modify_action_list AS stored, modify_action_list AS read_back FROM records WHERE distance >= 0""")
def q_edits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: scripts as the stored JSON text, and that text parsed and written again."""
    m = mine_compile_errors(spark, sf_dir).where(F.col("distance") >= 0)
    js = m.select("id", F.to_json(build_actions(F.col("acts"))).alias("stored"))
    shape = "array<struct<act_type:int,from_char:string,to_char:string,token_pos:int>>"
    return js.select("id", "stored", F.to_json(F.from_json("stored", shape)).alias("read_back"))


@register("edit_tuple", oracle=D_MINE_COMPILE + d_with_scripts(f"""
, sc AS (SELECT id, {d_script("mat", "a", "b", lambda i: f"ta[{i}]", lambda j: f"tb[{j}]")} AS acts FROM ws
  WHERE distance >= 0)
SELECT id, array_to_string(list_transform(acts, lambda x: x.act || ',' || x.pos || ',' ||
  CASE WHEN x.act = 3 THEN x.frm ELSE x."to" END), ';') AS tuples FROM sc"""))
def q_edit_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action -> (code, position, value); value is ``to`` for insert
    and change, ``from`` for delete."""
    m = mine_compile_errors(spark, sf_dir).where(F.col("distance") >= 0)
    with_value = lambda v: lambda x: F.concat_ws(",", x["act"].cast("string"), x["pos"].cast("string"), x[v])
    tup = build_actions(F.col("acts"), {DELETE: with_value("frm")}, default=with_value("to"))
    return m.select("id", F.array_join(tup, ";").alias("tuples"))


@register("miss_reasons", oracle=D_MINE_TEST + f"""
, cand AS (SELECT DISTINCT problem_user_id, refs FROM c WHERE status_code IN (1) AND seq IS NOT NULL)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN f.seq IS NULL THEN 'no_tokens'
    WHEN cand.problem_user_id IS NULL THEN 'no_candidate'
    WHEN nb.id IS NULL THEN 'none_within_bound' ELSE 'found' END AS reason
  FROM f LEFT JOIN nb ON f.id = nb.id LEFT JOIN cand ON f.problem_user_id = cand.problem_user_id AND f.refs = cand.refs)
GROUP BY reason""")
def q_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of the test-case mining job in one aggregate."""
    corpus = mining_corpus(spark, sf_dir, TEST).where(F.col("status_code").isin(*KEEP_FOR_TEST_MINING))
    return miss_reasons(corpus, TEST_FAIL_CODES, PASS_CODES, TEST_BOUND)


def miss_reasons(corpus: DataFrame, fail_codes, pass_codes, bound: int | None) -> DataFrame:
    """Failing rows of groups with both sides, counted by outcome. Copies
    share theirs, so they are counted before anything is joined."""
    failing, passing = (F.col("status_code").isin(*c) for c in (fail_codes, pass_codes))
    copies = materialize(corpus.sparkSession, corpus.where(failing).groupBy(*GROUP, "seq").agg(F.count("*").alias("_n")), "copies")
    ok = corpus.where(passing).select("id", *GROUP, "seq")
    near = nearest_partner(copies, ok, GROUP, id_col="id", seq_col="seq", max_distance=bound)
    near = near.join(groups_with_both(corpus, pass_codes, fail_codes), "problem_user_id", "left_semi")
    cand = ok.where(F.col("seq").isNotNull()).select(*GROUP).distinct().withColumn("_has", F.lit(True))
    r = near.join(cand, GROUP, "left").select("_n",
        F.when(F.col("seq").isNull(), "no_tokens").when(F.col("_has").isNull(), "no_candidate")
        .when(F.col("distance") < 0, "none_within_bound").otherwise("found").alias("reason"))
    return r.groupBy("reason").agg(F.sum("_n").cast("bigint").alias("n"))


@register("mined_total", oracle=f"""
SELECT 'compile' AS job, CAST(count(*) AS BIGINT) AS n FROM ({D_MINE_COMPILE} SELECT * FROM f)
UNION ALL SELECT 'test' AS job, CAST(count(*) AS BIGINT) AS n FROM ({D_MINE_TEST} SELECT * FROM f)""")
def q_mined_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by the two mining jobs."""
    a = mine_compile_errors(spark, sf_dir).agg(F.count("*").cast("bigint").alias("n")).select(
        F.lit("compile").alias("job"), "n")
    b = mine_test_errors(spark, sf_dir).agg(F.count("*").cast("bigint").alias("n")).select(
        F.lit("test").alias("job"), "n")
    return a.unionByName(b)


@register("distance_windows", oracle=D_MINE_COMPILE + f"""
SELECT CAST(count(CASE WHEN coalesce(nb.d, -1) <> -1 THEN 1 END) AS BIGINT) AS n_found,
  CAST(count(CASE WHEN nb.d > 0 AND nb.d < 10 THEN 1 END) AS BIGINT) AS n_train_window
FROM f LEFT JOIN nb ON f.id = nb.id""")
def q_distance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distance != -1 and the training window 0 < d < 10."""
    m = mine_compile_errors(spark, sf_dir)
    d = F.col("distance")
    return m.agg(F.count(F.when(d != -1, 1)).cast("bigint").alias("n_found"),
                 F.count(F.when((d > 0) & (d < 10), 1)).cast("bigint").alias("n_train_window"))


def success_job(spark: SparkSession, sf_dir: str, seed=7) -> DataFrame:
    """Language C -> verdicts {1,3} -> clean -> chunk -> flag; names
    decoded for the record (S14)."""
    cs = clean_corpus(dealt_submissions(spark, sf_dir))
    c = cs.where((F.col("language_code") == LANGUAGE["GNU C"]) & F.col("status_code").isin(*PASS_OR_WRONG))
    from repairmine.sources.sinks import chunk_rows
    ch = chunk_rows(c, "id", CHUNK_ROWS, CHUNK_BUCKETS, seed)
    return ch.select("id", F.lit(None).cast("string").alias("submit_url"), F.col("problem_name").alias("problem_id"),
                     "user_id", "problem_user_id", decode(F.col("language_code"), LANGUAGE).alias("language"),
                     decode(F.col("status_code"), VERDICT).alias("status"),
                     F.lit(None).cast("string").alias("error_test_id"),
                     (F.col("status_code") != 7).cast("int").alias("gcc_compile_result"),
                     "code", "bucket", "chunk")


D_SUCCESS = f"""WITH {D_SUBT}, {D_CLEAN_CTE},
c AS (SELECT * FROM cs WHERE language_code = 1 AND status_code IN (1, 3)),
b AS (SELECT *, ('0x' || substr(md5('7|' || id), 1, 8))::BIGINT % {CHUNK_BUCKETS} AS bucket FROM c),
ch AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY id) - 1) / {CHUNK_ROWS}) AS BIGINT) AS chunk
  FROM b)"""


@register("success_job", oracle=D_SUCCESS + """
SELECT id, problem_user_id, CASE status_code WHEN 1 THEN 'OK' WHEN 3 THEN 'WRONG_ANSWER' END AS status,
  CAST(bucket AS BIGINT) AS bucket, chunk, code FROM ch""")
def q_success_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = success_job(spark, sf_dir)
    return s.select("id", "problem_user_id", "status", F.col("bucket").cast("bigint").alias("bucket"),
                    F.col("chunk").cast("bigint").alias("chunk"), "code")


@register("success_records", oracle=D_SUCCESS + """
SELECT id, problem_name AS problem_id, user_id, problem_user_id, 'GNU C' AS language,
  CASE status_code WHEN 1 THEN 'OK' WHEN 3 THEN 'WRONG_ANSWER' END AS status, 1 AS gcc_compile_result, code FROM ch""")
def q_success_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success-table records with decoded names and the 0/1 flag."""
    s = success_job(spark, sf_dir)
    return s.select("id", "problem_id", "user_id", "problem_user_id", "language", "status", "gcc_compile_result",
                    "code")


@register("distinct_failures", oracle=D_MINE_COMPILE + """
, ok AS (SELECT f.id, f.problem_user_id FROM f JOIN nb ON f.id = nb.id)
SELECT id, problem_user_id FROM (SELECT *, row_number() OVER (PARTITION BY problem_user_id
  ORDER BY md5('7|' || id), id) AS rn FROM ok) WHERE rn = 1""")
def q_distinct_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined failures with a partner (distance != -1), one per
    problem-user."""
    from repairmine.operators.sample import cap_per_key
    m = mine_compile_errors(spark, sf_dir).where(F.col("distance") != -1).select("id", "problem_user_id")
    return cap_per_key(m, ["problem_user_id"], 1, 7)


@register("distinct_successes", oracle=D_SUCCESS + """
, ok AS (SELECT id, problem_user_id FROM ch)
SELECT id, problem_user_id FROM (SELECT *, row_number() OVER (PARTITION BY problem_user_id
  ORDER BY md5('7|' || id), id) AS rn FROM ok) WHERE rn = 1""")
def q_distinct_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success records that compile (flag 1), one per problem-user."""
    from repairmine.operators.sample import cap_per_key
    s = success_job(spark, sf_dir).where(F.col("gcc_compile_result") == 1).select("id", "problem_user_id")
    return cap_per_key(s, ["problem_user_id"], 1, 7)


def strict_pairs(df: DataFrame, fixed_ok: str, orig_ok: str) -> DataFrame:
    """pairs whose repaired text passes and whose original fails the
    stricter check (both verdicts are input columns)."""
    return df.where(F.col(fixed_ok) & ~F.col(orig_ok))


STRICT_MS = 700  # the stricter check is a run time under this limit


@register("strict_pairs", oracle=D_MINE_TEST + f"""
, ms AS (SELECT id, TRY_CAST(trim(replace(time, 'ms', '')) AS INTEGER) AS t FROM sub)
SELECT f.id, nb.similar_id FROM f JOIN nb ON f.id = nb.id JOIN ms o ON o.id = f.id JOIN ms r ON r.id = nb.similar_id
WHERE r.t < {STRICT_MS} AND NOT o.t < {STRICT_MS}""")
def q_strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 on the test-case mining output: the partner runs under the limit,
    the original does not (both run times are columns of the input)."""
    m = mine_test_errors(spark, sf_dir).where(F.col("distance") >= 0)
    times = mining_corpus(spark, sf_dir, TEST).select(F.col("id").alias("similar_id"), F.col("time").alias("similar_time"))
    m = m.join(times, "similar_id").withColumn("fixed_ok", F.col("similar_time") < STRICT_MS).withColumn(
        "orig_ok", F.col("time") < STRICT_MS)
    return strict_pairs(m, "fixed_ok", "orig_ok").select("id", "similar_id")
