"""Registered queries: sampling (T*), joins (J*), aggregations (A*), filters (F*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions.dicts import (COMPILE_FAIL_CODES, KEEP_FOR_TEST_MINING, PASS_CODES, PASS_OR_WRONG,
                                        TEST_FAIL_CODES, VERDICT)
from repairmine.operators import sample as T
from repairmine.plans.registry import register
from repairmine.plans.sqltext import case_map
from repairmine.sources.submissions import SUB_CTE, submissions, typed_submissions
from repairmine.sources.tables import read_table

SEED = 7
D_SUBV = SUB_CTE + f", subv AS (SELECT *, {case_map('status', VERDICT)} AS status_code FROM sub)"


def _sub(spark, sf_dir):
    return typed_submissions(submissions(spark, sf_dir))


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders")


def d_cap(table: str, key: str, id_col: str, n: int, cols: str, seed=SEED) -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY "
            f"md5('{seed}|' || CAST({id_col} AS VARCHAR)), {id_col}) AS rn FROM {table}) WHERE rn <= {n}")


def d_first_k(table: str, key: str, frac: float, seed=SEED) -> str:
    return (f"SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), "
            f"{key}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL)) "
            f"WHERE rn <= floor(n * {frac})")


# --- T: sampling ---------------------------------------------------------------

@register("cap_per_key", oracle=d_cap("orders", "o_custkey", "o_orderkey", 3, "o_orderkey, o_custkey"))
def q_cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 orders per customer."""
    return T.cap_per_key(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), ["o_custkey"], 3, SEED,
                         "o_orderkey")


@register("one_per_problem_user", oracle="WITH " + D_SUBV + " "
          + d_cap("subv", "problem_user_id", "id", 1, "id, problem_user_id"))
def q_one_per_problem_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per problem-user."""
    return T.cap_per_key(_sub(spark, sf_dir).select("id", "problem_user_id"), ["problem_user_id"], 1, SEED)


@register("cap_per_problem", oracle="WITH " + D_SUBV + " " + d_cap("subv", "problem_name", "id", 10, "id, problem_name"))
def q_cap_per_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 10 rows per problem."""
    return T.cap_per_key(_sub(spark, sf_dir).select("id", "problem_name"), ["problem_name"], 10, SEED)


@register("cap_per_user", oracle="WITH " + D_SUBV + " " + d_cap("subv", "user_id", "id", 10, "id, user_id"))
def q_cap_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: at most 10 rows per user."""
    return T.cap_per_key(_sub(spark, sf_dir).select("id", "user_id"), ["user_id"], 10, SEED)


def balanced_sample(df: DataFrame, seed=SEED) -> DataFrame:
    """T5: one per problem-user, then 10 per problem, then 10 per user."""
    one = T.cap_per_key(df, ["problem_user_id"], 1, seed)
    per_problem = T.cap_per_key(one, ["problem_name"], 10, seed)
    return T.cap_per_key(per_problem, ["user_id"], 10, seed)


@register("balanced_sample", oracle="WITH " + D_SUBV
          + ", s1 AS (" + d_cap("subv", "problem_user_id", "id", 1, "id, problem_user_id, problem_name, user_id") + ")"
          + ", s2 AS (" + d_cap("s1", "problem_name", "id", 10, "id, problem_user_id, problem_name, user_id") + ")"
          + " " + d_cap("s2", "user_id", "id", 10, "id, problem_user_id, problem_name, user_id"))
def q_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_sample(_sub(spark, sf_dir).select("id", "problem_user_id", "problem_name", "user_id"))


@register("holdout_users", oracle=d_first_k("orders", "o_custkey", 0.1))
def q_holdout_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 % of the distinct customers."""
    return T.holdout_keys(_orders(spark, sf_dir), "o_custkey", 0.1, SEED)


@register("three_way_split", oracle=f"""
WITH te AS ({d_first_k("orders", "o_custkey", 0.1)}),
rest AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM te) AND o_custkey IS NOT NULL),
va AS ({d_first_k("rest", "o_custkey", 0.1, seed=f"{SEED}/valid")})
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM te) THEN 'test'
  WHEN o_custkey IN (SELECT o_custkey FROM va) THEN 'valid' ELSE 'train' END AS split FROM orders""")
def q_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test / valid / train by customer."""
    return T.three_way_split(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", SEED).select(
        "o_orderkey", "split")


@register("weighted_choice", oracle=f"""
SELECT event_id, CASE WHEN u < 5 THEN 0 WHEN u < 6 THEN 1 WHEN u < 10 THEN 2 END AS choice FROM (
  SELECT event_id, ('0x' || substr(md5('{SEED}|' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS u FROM events)""")
def q_weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5 / 1 / 4 (change / insert / delete of the corruption job)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", T.weighted_choice([5, 1, 4], SEED, F.col("event_id")).alias("choice"))


# --- J: joins ------------------------------------------------------------------

@register("enrich_left_join", oracle="""
SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact left join dimension; AQE picks a broadcast only below the
    measured-size threshold, so no unchecked broadcast hint."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return o.join(c, "o_custkey", "left").select("o_orderkey", "c_name", "c_mktsegment")


@register("anti_users", oracle=f"""
WITH {D_SUBV} SELECT id, user_id FROM subv WHERE status_code = 1
  AND user_id NOT IN (SELECT user_id FROM subv WHERE status_code = 7 AND user_id IS NOT NULL)""")
def q_anti_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing rows of users without any compile failure; ``left_anti``
    on the user, never ``NOT IN``."""
    s = _sub(spark, sf_dir)
    bad = s.where(F.col("status_code") == 7).select("user_id").distinct()
    return s.where(F.col("status_code") == 1).join(bad, "user_id", "left_anti").select("id", "user_id")


D_BOTH = """both_keys AS (SELECT problem_user_id FROM subv GROUP BY problem_user_id
  HAVING bool_or(status_code = 1) AND bool_or(status_code = 7))"""


def groups_with_both(df: DataFrame, ok_codes, err_codes, key: str = "problem_user_id") -> DataFrame:
    """A2/A3: keys of groups that hold a passing and a failing row."""
    return (df.groupBy(key)
            .agg(F.bool_or(F.col("status_code").isin(*ok_codes)).alias("_ok"),
                 F.bool_or(F.col("status_code").isin(*err_codes)).alias("_err"))
            .where(F.col("_ok") & F.col("_err")).select(key))


@register("skip_done", oracle=f"""
WITH {D_SUBV}, {D_BOTH}
SELECT id FROM subv WHERE problem_user_id NOT IN (SELECT problem_user_id FROM both_keys)""")
def q_skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the compile-failure job already handled are skipped."""
    s = _sub(spark, sf_dir)
    done = groups_with_both(s, PASS_CODES, COMPILE_FAIL_CODES)
    return s.join(done, "problem_user_id", "left_anti").select("id")


@register("user_split", oracle=f"""
WITH h AS ({d_first_k("orders", "o_custkey", 0.2)})
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM h) THEN 'in' ELSE 'out' END AS split FROM orders""")
def q_user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in / out of a sampled customer set, as one labelled join."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    chosen = T.holdout_keys(o, "o_custkey", 0.2, SEED)
    return T.split_by_keys(o, "o_custkey", chosen, "in", "out").select("o_orderkey", "split")


# --- A: aggregations -------------------------------------------------------------

@register("group_sizes", oracle=f"""
WITH {D_SUBV} SELECT problem_user_id, CAST(count(*) AS BIGINT) AS n FROM subv GROUP BY problem_user_id""")
def q_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return _sub(spark, sf_dir).groupBy("problem_user_id").agg(F.count("*").cast("bigint").alias("n"))


@register("groups_with_both", oracle=f"""
WITH {D_SUBV}, {D_BOTH} SELECT id, problem_user_id FROM subv WHERE problem_user_id IN (SELECT problem_user_id FROM both_keys)""")
def q_groups_with_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: rows of groups with a pass (1) and a compile failure (7)."""
    s = _sub(spark, sf_dir)
    return s.join(groups_with_both(s, PASS_CODES, COMPILE_FAIL_CODES), "problem_user_id", "left_semi").select(
        "id", "problem_user_id")


@register("groups_with_both_test", oracle=f"""
WITH {D_SUBV}, k AS (SELECT problem_user_id FROM subv GROUP BY problem_user_id
  HAVING bool_or(status_code = 1) AND bool_or(status_code IN (3, 4, 5, 6)))
SELECT id, problem_user_id FROM subv WHERE problem_user_id IN (SELECT problem_user_id FROM k)""")
def q_groups_with_both_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows of groups with a pass and a test-case failure."""
    s = _sub(spark, sf_dir)
    return s.join(groups_with_both(s, PASS_CODES, TEST_FAIL_CODES), "problem_user_id", "left_semi").select(
        "id", "problem_user_id")


@register("user_count", oracle="SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_users FROM orders")
def q_user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return _orders(spark, sf_dir).agg(F.countDistinct("o_custkey").cast("bigint").alias("n_users"))


@register("success_totals", oracle=f"""
WITH {D_SUBV} SELECT problem_name, CAST(sum(CASE WHEN status_code <> 7 THEN 1 ELSE 0 END) AS BIGINT) AS n_success,
  CAST(count(status_code) AS BIGINT) AS n_known, CAST(count(*) AS BIGINT) AS n_total FROM subv GROUP BY problem_name""")
def q_success_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: compile-success flag sum and row counts per problem; the flag of
    an unmapped verdict is unknown and counts for neither side."""
    s = _sub(spark, sf_dir).withColumn("flag", (F.col("status_code") != 7).cast("int"))
    return s.groupBy("problem_name").agg(F.coalesce(F.sum("flag"), F.lit(0)).cast("bigint").alias("n_success"),
                                         F.count("flag").cast("bigint").alias("n_known"),
                                         F.count("*").cast("bigint").alias("n_total"))


# --- F: filters ------------------------------------------------------------------

@register("verdict_sets", oracle=f"""
WITH {D_SUBV} SELECT CAST(count(CASE WHEN status_code IN (1, 3) THEN 1 END) AS BIGINT) AS n_pass_or_wrong,
  CAST(count(CASE WHEN status_code IN (3, 4, 5, 6) THEN 1 END) AS BIGINT) AS n_test_fail,
  CAST(count(CASE WHEN status_code = 1 THEN 1 END) AS BIGINT) AS n_pass,
  CAST(count(CASE WHEN status_code IN (1, 3, 4, 5, 6) THEN 1 END) AS BIGINT) AS n_keep FROM subv""")
def q_verdict_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the four verdict sets, counted in one pass."""
    s = _sub(spark, sf_dir)
    c = F.col("status_code")
    return s.agg(F.count(F.when(c.isin(*PASS_OR_WRONG), 1)).cast("bigint").alias("n_pass_or_wrong"),
                 F.count(F.when(c.isin(*TEST_FAIL_CODES), 1)).cast("bigint").alias("n_test_fail"),
                 F.count(F.when(c.isin(*PASS_CODES), 1)).cast("bigint").alias("n_pass"),
                 F.count(F.when(c.isin(*KEEP_FOR_TEST_MINING), 1)).cast("bigint").alias("n_keep"))


@register("success_only", oracle=f"""
WITH {D_SUBV} SELECT id FROM subv WHERE status_code <> 7""")
def q_success_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose compile-success flag is 1 (unmapped verdicts are unknown)."""
    s = _sub(spark, sf_dir)
    return s.where(F.col("status_code") != 7).select("id")
