"""Event weeks: the minimum end-to-end question.

"For each user-week with more errors than purchases, which other week of the
same user is nearest by its event sequence, and by which edits?"

Record = ``(user_id, week)`` with ``week = floor((day_of_month(ts) - 1) / 7)``;
its sequence = first letter of ``event_type`` ordered by ``(ts, event_id)``.
Failing = more ``error`` than ``purchase`` events; passing = the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.operators.distance import nearest_partner
from repairmine.operators.edits import apply_sql, matrix_sql, script_text, with_script_arrow
from repairmine.plans.registry import register
from repairmine.plans.sqltext import d_matrix, d_script, d_script_text
from repairmine.sources.tables import read_table


def event_weeks(events: DataFrame) -> DataFrame:
    """One row per user-week: ``user_id, week, seq, toks, n_err, n_pur, failing``."""
    ev = (events.where(F.col("user_id").isNotNull())
          .select("user_id", "ts", "event_id", "event_type",
                  F.floor((F.dayofmonth("ts") - 1) / 7).cast("bigint").alias("week")))
    wk = (ev.groupBy("user_id", "week")
          .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id",
                                                     F.substring("event_type", 1, 1).alias("s")))).alias("_l"),
               F.sum((F.col("event_type") == "error").cast("bigint")).alias("n_err"),
               F.sum((F.col("event_type") == "purchase").cast("bigint")).alias("n_pur")))
    return (wk.select("user_id", "week",
                      F.transform("_l", lambda x: x["s"]).alias("toks"), "n_err", "n_pur")
            .withColumn("seq", F.array_join("toks", ""))
            .withColumn("failing", F.col("n_err") > F.col("n_pur")))


def nearest_weeks(events: DataFrame) -> DataFrame:
    """D4 on event weeks: every failing week with its nearest passing week."""
    wk = event_weeks(events)
    fail = wk.where("failing").select("user_id", "week", "seq", "toks")
    ok = wk.where(~F.col("failing")).select("user_id", "week", "seq")
    near = nearest_partner(fail, ok, ["user_id"], id_col="week", seq_col="seq")
    return near.withColumnRenamed("similar_id", "similar_week")


def week_scripts(events: DataFrame) -> DataFrame:
    """D3 + D5 + D6 on the winners of ``nearest_weeks`` (partnered rows)."""
    near = nearest_weeks(events).where(F.col("distance") >= 0)
    return (near
            .withColumn("similar_toks", F.when(F.col("similar_seq") == "", F.array().cast("array<string>"))
                        .otherwise(F.split(F.col("similar_seq"), "(?!$)")))
            .transform(lambda d: with_script_arrow(d, "seq", "similar_seq", "toks", "similar_toks"))
            .withColumn("applied", F.expr(apply_sql("similar_toks", "acts"))))


_WEEKS_CTE = """
ev AS (
  SELECT user_id, CAST(floor((dayofmonth(ts) - 1) / 7) AS BIGINT) AS week, ts, event_id, event_type
  FROM events WHERE user_id IS NOT NULL),
wk AS (
  SELECT user_id, week, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS seq,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_err,
         sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_pur
  FROM ev GROUP BY user_id, week),
f AS (SELECT * FROM wk WHERE n_err > n_pur),
p AS (SELECT * FROM wk WHERE n_err <= n_pur),
pr AS (
  SELECT f.user_id, f.week, p.week AS similar_week, p.seq AS similar_seq,
         levenshtein(f.seq, p.seq) AS distance,
         row_number() OVER (PARTITION BY f.user_id, f.week ORDER BY levenshtein(f.seq, p.seq), p.week) AS rn
  FROM f JOIN p ON f.user_id = p.user_id),
best AS (
  SELECT f.user_id, f.week, f.seq, pr.similar_week, pr.similar_seq,
         CAST(coalesce(pr.distance, -1) AS BIGINT) AS distance
  FROM f LEFT JOIN pr ON f.user_id = pr.user_id AND f.week = pr.week AND pr.rn = 1)
"""


@register("nearest_week", oracle="WITH " + _WEEKS_CTE + """
SELECT user_id, week, seq, similar_week, similar_seq, distance FROM best""")
def q_nearest_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_weeks(read_table(spark, sf_dir, "events"))
    return near.select("user_id", "week", "seq", "similar_week", "similar_seq",
                       F.col("distance").cast("bigint").alias("distance"))


_D_SCRIPT = d_script_text(d_script("mat", "seq", "similar_seq", lambda i: f"substr(seq, {i}, 1)",
                                     lambda j: f"substr(similar_seq, {j}, 1)"))


@register("edit_script", oracle="WITH " + _WEEKS_CTE + f"""
, w AS (SELECT *, {d_matrix("seq", "similar_seq")} AS mat FROM best WHERE distance >= 0)
SELECT user_id, week, distance AS n_acts, {_D_SCRIPT} AS script, seq AS applied, 1 AS round_trip FROM w""")
def q_edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script from the passing week to the failing one; its size is
    the distance and applying it (D6) gives the failing sequence (D7)."""
    s = week_scripts(read_table(spark, sf_dir, "events"))
    return s.select("user_id", "week", F.size("acts").cast("bigint").alias("n_acts"),
                    script_text(F.col("acts")).alias("script"),
                    F.array_join("applied", "").alias("applied"),
                    (F.array_join("applied", "") == F.col("seq")).cast("int").alias("round_trip"))


@register("distance_matrix", oracle="WITH " + _WEEKS_CTE + f"""
, w AS (SELECT *, {d_matrix("seq", "similar_seq")} AS mat FROM best WHERE distance >= 0)
SELECT user_id, week, distance AS last_cell,
  array_to_string(list_transform(mat, lambda r: array_to_string(r, ',')), '|') AS cells FROM w""")
def q_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: all cells of the matrix of each winning pair; the last one is the
    distance."""
    s = week_scripts(read_table(spark, sf_dir, "events")).withColumn("m", F.expr(matrix_sql("seq", "similar_seq")))
    return s.select("user_id", "week", F.element_at(F.element_at("m", -1), -1).cast("bigint").alias("last_cell"),
                    F.array_join(F.transform("m", lambda r: F.array_join(r.cast("array<string>"), ",")), "|").alias("cells"))


@register("script_round_trip", oracle="WITH " + _WEEKS_CTE + """
SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(0 AS BIGINT) AS n_failed FROM best WHERE distance >= 0""")
def q_script_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of pairs whose script does not lead back (must be 0)."""
    s = week_scripts(read_table(spark, sf_dir, "events"))
    return s.agg(F.count("*").cast("bigint").alias("n_pairs"),
                 F.sum((F.array_join("applied", "") != F.col("seq")).cast("bigint"))
                 .cast("bigint").alias("n_failed"))


def week_script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts as text, for fixtures and inspection."""
    s = week_scripts(read_table(spark, sf_dir, "events"))
    return s.select("user_id", "week", "seq", "similar_seq", "distance", script_text(F.col("acts")).alias("script"))
