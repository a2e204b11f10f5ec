"""Registered queries: streaming jobs (R1-R4); each returns its final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.plans.registry import register
from repairmine.sources.tables import read_table
from repairmine.streaming import jobs as R

CAP = 3


@register("stream_insert_ignore", oracle="""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE user_id IS NOT NULL) WHERE rn = 1""")
def q_stream_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per user, kept across micro-batches."""
    return R.stream_insert_ignore(spark, sf_dir).select("user_id", "event_id")


@register("stream_skip_done", oracle="""
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup'
  AND s.user_id = e.user_id AND CAST(s.ts AS DATE) = CAST(e.ts AS DATE))""")
def q_stream_skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: events of user-days not done yet (done = user-days with a signup)."""
    done = (read_table(spark, sf_dir, "events").where("event_type = 'signup'")
            .select("user_id", F.to_date("ts").alias("day")))
    return R.stream_skip_done(spark, sf_dir, done).select("event_id")


@register("stream_retry", oracle=f"""
WITH a AS (SELECT user_id, event_type, row_number() OVER w AS k,
    coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tries,
    coalesce(bool_or(event_type = 'purchase') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
  FROM events WHERE event_type IN ('error', 'purchase') AND user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS try_count,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'done' WHEN count(*) FILTER (event_type = 'error') >= {CAP} THEN 'failed'
       ELSE 'waiting' END AS outcome FROM a WHERE tries < {CAP} AND NOT ended GROUP BY user_id""")
def q_stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries and outcome of every user's job, with a cap of 3 tries."""
    return R.stream_retry(spark, sf_dir, CAP)


@register("stream_retry_totals", oracle=f"""
WITH a AS (SELECT user_id, event_type, row_number() OVER w AS k,
    coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tries,
    coalesce(bool_or(event_type = 'purchase') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
  FROM events WHERE event_type IN ('error', 'purchase') AND user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'purchase') AS ok
  FROM a WHERE tries < {CAP} AND NOT ended GROUP BY user_id),
o AS (SELECT CASE WHEN ok THEN 'done' WHEN errors >= {CAP} THEN 'failed' ELSE 'waiting' END AS outcome, 1 AS n FROM u
  UNION ALL SELECT 'read', 1 FROM u
  UNION ALL SELECT 'repeat', least(errors, {CAP} - 1) FROM u WHERE errors > 0)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY outcome""")
def q_stream_retry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, repeats and ends of the retry loop."""
    return R.stream_retry_totals(spark, sf_dir, CAP).select("outcome", F.col("n").cast("bigint").alias("n"))


@register("stream_outcomes", oracle="""
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'read' AS outcome FROM events
  UNION ALL SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END FROM events)
WHERE outcome IS NOT NULL GROUP BY outcome""")
def q_stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of read / done / failed rows."""
    return R.stream_outcomes(spark, sf_dir).select("outcome", F.col("n").cast("bigint").alias("n"))
