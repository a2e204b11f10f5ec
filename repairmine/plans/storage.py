"""Registered queries: scans, result tables and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions.hashing import cell_hash_sum
from repairmine.plans.mining import D_RECORDS, mine_compile_errors, mined_record
from repairmine.plans.registry import register
from repairmine.plans.relational import D_SUBV
from repairmine.session import scratch_path
from repairmine.sources import sinks as S
from repairmine.sources.submissions import by_language, problem_user_rows, submissions, typed_submissions
from repairmine.sources.tables import read_table, scan_where

SEED = 7


@register("scan_where", oracle="""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'""")
def q_scan_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND of (column, op, value) conditions, pushed into the parquet
    scan (``PushedFilters``) with a two-column ``ReadSchema``."""
    return scan_where(read_table(spark, sf_dir, "orders"),
                      [("o_orderstatus", "=", "F"), ("o_totalprice", ">", 100000), ("o_orderpriority", "<>", "5-LOW")],
                      ["o_orderkey", "o_custkey"])


@register("scan_language", oracle=f"""WITH {D_SUBV},
pr AS (SELECT problem_name, array_to_string(list_sort(list_distinct(list(language))), ':') AS tags FROM sub GROUP BY problem_name)
SELECT s.id, s.problem_name, pr.tags FROM subv s LEFT JOIN pr ON s.problem_name = pr.problem_name WHERE s.language = 'GNU C'""")
def q_scan_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of one language with the two-column problem read."""
    t = by_language(typed_submissions(submissions(spark, sf_dir)), "GNU C")
    return t.select("id", "problem_name", F.array_join("tags", ":").alias("tags"))


@register("scan_problem_user", oracle=f"""WITH {D_SUBV}
SELECT id, status FROM subv WHERE problem_name = 'P1' AND user_id = 'U7' AND language = 'GNU C++'""")
def q_scan_problem_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: point read of one problem and one user."""
    return problem_user_rows(submissions(spark, sf_dir), "P1", "U7", "GNU C++").select("id", "status")


@register("distinct_keys", oracle=f"WITH {D_SUBV} SELECT DISTINCT problem_user_id FROM subv")
def q_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of a table."""
    return S.done_keys(submissions(spark, sf_dir))


@register("lookup_ids", oracle="""
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)""")
def q_lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is in an id list (the customers of one nation)."""
    ids = read_table(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    return S.lookup_ids(read_table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey")


# Statements by name, with a place for the table and bound parameters.
STATEMENTS = {
    "orders_by_status": "SELECT o_orderkey, o_totalprice FROM {t} WHERE o_orderstatus = :status AND o_orderpriority = :prio",
    "orders_of_customer": "SELECT o_orderkey, o_totalprice FROM {t} WHERE o_custkey = :custkey",
    "count_rows": "SELECT count(*) AS n FROM {t}",
}


def run_statement(table: DataFrame, name: str, **args) -> DataFrame:
    """Look a statement up by name and run it on a table."""
    if name not in STATEMENTS:
        raise KeyError(f"no statement {name!r}")
    return table.sparkSession.sql(STATEMENTS[name], args=args, t=table)


@register("named_statement", oracle="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def q_named_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named statement with bound parameters and a table argument."""
    return run_statement(read_table(spark, sf_dir, "orders"), "orders_by_status", status="O", prio="1-URGENT")


@register("chunk_rows", oracle=f"""
WITH b AS (SELECT o_orderkey, ('0x' || substr(md5('{SEED}|' || o_orderkey), 1, 8))::BIGINT % 8 AS bucket FROM orders)
SELECT o_orderkey, CAST(bucket AS BIGINT) AS bucket,
  CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS chunk FROM b""")
def q_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of 100 rows inside 8 hash buckets."""
    c = S.chunk_rows(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 8, SEED)
    return c.select("o_orderkey", F.col("bucket").cast("bigint").alias("bucket"), F.col("chunk").cast("bigint").alias("chunk"))


@register("table_fingerprint", oracle="""
SELECT CAST(sum(('0x' || substr(md5(concat_ws(chr(1), coalesce(CAST(o_orderkey AS VARCHAR), chr(0)),
  coalesce(CAST(o_custkey AS VARCHAR), chr(0)), coalesce(o_orderstatus, chr(0)),
  coalesce(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), chr(0)),
  coalesce(CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR), chr(0)), coalesce(o_orderpriority, chr(0)))), 1, 12))::BIGINT)
  AS VARCHAR) AS fingerprint, CAST(count(*) AS BIGINT) AS n_rows FROM orders""")
def q_table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content hash of all columns (sum of per-row md5
    numbers); prices as cents and dates as seconds, which both engines print alike."""
    o = read_table(spark, sf_dir, "orders")
    seconds = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("bigint") * 86400 + (
        F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.floor(F.second("o_orderdate")))
    fp = S.fingerprint(o.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint"),
                                seconds, "o_orderpriority"))
    return fp.select(F.col("fingerprint").cast("string").alias("fingerprint"), "n_rows")


@register("insert_ignore", oracle="""
WITH b1 AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
f1 AS (SELECT o_custkey, o_orderkey, 1 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS rn FROM b1) WHERE rn = 1),
f2 AS (SELECT o_custkey, o_orderkey, 2 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM f1))
SELECT * FROM f1 UNION ALL SELECT * FROM f2""")
def q_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore keyed by customer: the first row per key wins in
    a batch, and keys already in the target are skipped (batch 1 = finished
    orders, then batch 2 = all orders)."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    t1 = S.insert_ignore(o.where("o_orderstatus = 'F'"), None, order, "o_custkey").withColumn("batch", F.lit(1))
    t2 = S.insert_ignore(o, t1, order, "o_custkey").withColumn("batch", F.lit(2))
    return t1.unionByName(t2).select("o_custkey", "o_orderkey", "batch")


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7 + S4: the compile-failure records appended (insert-or-ignore)
    to a fresh result table in the shared folder, then read back."""
    import uuid
    path = scratch_path(spark, f"actual_c_error_records-{uuid.uuid4().hex}")
    recs = mined_record(mine_compile_errors(spark, sf_dir), 0)
    S.append_ignore(spark, recs, path, "actual_c_error_records", [F.col("id")])
    return spark.read.parquet(path)


@register("read_results", oracle=D_RECORDS + " SELECT id, problem_user_id, distance FROM records")
def q_read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table read back after the write."""
    return written_results(spark, sf_dir).select("id", "problem_user_id", "distance")


@register("scan_distance_window", oracle=D_RECORDS + """
SELECT id, distance FROM records WHERE distance >= 0 AND distance < 10""")
def q_scan_distance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with 0 <= distance < 10."""
    r = written_results(spark, sf_dir)
    return scan_where(r, [("distance", ">=", 0), ("distance", "<", 10)], ["id", "distance"])
