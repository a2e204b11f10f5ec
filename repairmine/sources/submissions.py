"""The derived submission view ``sub`` and its readers.

The test tables hold no judge submissions, so a view over ``orders`` gives
rows with the submission shape: problem, user, language, verdict, units,
a timestamp and a code-like text. Users ``U0, U10, ..`` have no failure, one
row in 11 holds a call without arguments, one in 53 up to 39 more statements
(so distances reach 0 to about 230), and one verdict in 7 is unmapped. The SELECT runs unchanged in Spark
SQL and DuckDB, so every query on ``sub`` has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions.clean import once, strip_unit, trim_ends
from repairmine.functions.dicts import LANGUAGE, VERDICT, encode
from repairmine.session import written_once
from repairmine.sources.tables import read_table

# Fixed text of the view; shared with the DuckDB oracles (as a CTE).
SUB_SELECT = """
select cast(o_orderkey as string) id, concat('P',o_orderkey%4) problem_name, concat('U',o_custkey%250) user_id,
 concat('P',o_orderkey%4,'_','U',o_custkey%250) problem_user_id,
 case o_orderkey%5 when 0 then 'GNU C++' when 1 then 'GNU C11' else 'GNU C' end as language,
 case when o_orderkey%7<3 or (o_orderkey%7<5 and o_custkey%250%10=0) then 'OK'
      when o_orderkey%7<5 then 'COMPILATION_ERROR'
      when o_orderkey%7=5 then 'WRONG_ANSWER' else 'UNKNOWN_X' end as status,
 concat(o_orderkey%1000,' ms') as time, concat(o_orderkey%4096,' KB') as memory, o_orderdate as submit_time,
 concat('[','#include <',case o_custkey%2 when 0 then 'stdio.h' else 'math.h' end,'>',chr(13),chr(10),chr(9),
  'int  v',o_custkey%7,' = ',o_orderkey%5,' ; // ',substr(o_orderpriority,3),chr(10),'   ',chr(10),
  '/* ',o_orderstatus,' */ if ( v',o_orderkey%3,' ',
  case o_orderkey%3 when 0 then '==' when 1 then '<=' else '>' end,' ',o_custkey%5,' ) { return v',o_custkey%7,
  case when o_orderkey%7 in (3,4) then '' else ' ;' end,
  case when o_orderkey%11=0 then ' f ( ) ;' else '' end,
  repeat(' v1 = v1 + 1 ;', case when o_orderkey%53=0 then o_orderkey%40 else 0 end),' }',
  case when o_orderkey%97=0 then chr(233) else '' end,']') as code
from {orders}
"""

SUB_CTE = "sub AS (" + SUB_SELECT.replace("{orders}", "orders") + ")"
# spark.sql(..., orders=df) formats the text: literal braces are doubled.
_SUB_SPARK = SUB_SELECT.replace("{", "{{").replace("}", "}}").replace("{{orders}}", "{orders}")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``sub`` view over ``orders`` (lazy; Catalyst prunes unused columns)."""
    return spark.sql(_SUB_SPARK, orders=read_table(spark, sf_dir, "orders"))


#: Rows of one task of a job that cleans and tokenizes submissions.
ROWS_A_TASK = 20000


def dealt(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``rows`` rows. A scan has no more
    tasks than its file has row groups, however much is computed on a row; the
    count comes from the files' footers."""
    return df.repartition(max(1, -(-df.count() // rows)))


def dealt_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed submissions (S2) for work that is heavy by the row: the
    view's rows are dealt to tasks, its problem dimension is written first. Its
    size is known then: left to the run, the join took dealt rows by problem, a
    task each, whenever they were there before the dimension was.
    They are dealt by their place in the file: equal rows part, and a row group
    is not sorted, as it is to be dealt in turn. ``code`` is a generated column,
    so a filter on it does not build the texts where the row groups are read."""
    orders = read_table(spark, sf_dir, "orders")
    orders = orders.repartition(max(1, -(-orders.count() // ROWS_A_TASK)), "_metadata.file_path", "_metadata.row_index")
    sub = spark.sql(_SUB_SPARK, orders=orders)
    dim = written_once(spark, "problems", [f"{sf_dir}/orders.parquet"], lambda: problems(submissions(spark, sf_dir)))
    return typed_submissions(sub, dim).withColumn("code", once(F.col("code")))


def problems(sub: DataFrame) -> DataFrame:
    """Problem dimension ``(problem_name, tags)``: a small table derived from
    the submissions (tags = the languages seen, joined by ':')."""
    return (sub.groupBy("problem_name")
            .agg(F.array_join(F.array_sort(F.collect_set("language")), ":").alias("tags")))


def by_language(sub: DataFrame, language: str | None) -> DataFrame:
    """Submissions of one language (None = all)."""
    return sub if language is None else sub.where(F.col("language") == language)


def problem_user_rows(sub: DataFrame, problem_name: str, user_id: str,
                      language: str | None = None) -> DataFrame:
    """S3: point read of one problem and one user."""
    cond = (F.col("problem_name") == problem_name) & (F.col("user_id") == user_id)
    if language is not None:
        cond = cond & (F.col("language") == language)
    return sub.where(cond)


def typed_submissions(sub: DataFrame, problem_df: DataFrame | None = None) -> DataFrame:
    """S2 read step: left join the problem tags (J1; a dimension, which AQE
    broadcasts only when its measured size is under the threshold), strip units (P1), parse the time (P2), split tags (P3), drop the
    first and last character of the code (P4), encode language and verdict
    (P5; raw values kept)."""
    pr = problems(sub) if problem_df is None else problem_df
    return (sub.join(pr, "problem_name", "left")
            .select("id", "problem_name", "user_id", "problem_user_id", "language",
                    encode(F.col("language"), LANGUAGE).alias("language_code"), "status",
                    encode(F.col("status"), VERDICT).alias("status_code"),
                    strip_unit(F.col("time"), "ms").alias("time"), strip_unit(F.col("memory"), "KB").alias("memory"),
                    F.to_timestamp(F.col("submit_time").cast("string")).alias("submit_time"),
                    F.split("tags", ":", -1).alias("tags"), trim_ends(F.col("code")).alias("code")))
