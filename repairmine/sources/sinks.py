"""Result tables: schemas, insert-or-ignore, chunking, fingerprints.

Result tables are parquet folders. Writes are idempotent: a batch is
deduplicated on ``id`` (first row wins by a given order) and anti-joined with
the rows already present, so a job that is re-run after a lost executor or a
driver restart does not duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repairmine.session import materialize, table_exists

from repairmine.functions.hashing import cell_hash_sum, md5_mod

_S, _I = T.StringType(), T.IntegerType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, n != "id") for n, t in fields])


_MINED = [("id", _S), ("submit_url", _S), ("problem_id", _S), ("user_id", _S), ("problem_user_id", _S),
          ("code", _S)]
_RESULT = [("similar_code", _S), ("modify_action_list", _S), ("distance", _I)]

# The five result tables and their column defaults.
RESULT_SCHEMAS = {
    "actual_c_error_records": _schema(*_MINED, ("gcc_compile_result", _I), ("pycparser_result", _I), *_RESULT),
    "cpp_testcase_error_records": _schema(*_MINED, ("gcc_compile_result", _I), *_RESULT, ("testcase", _S)),
    "c_compile_success_records": _schema(("id", _S), ("submit_url", _S), ("problem_id", _S), ("user_id", _S),
                                         ("problem_user_id", _S), ("language", _S), ("status", _S),
                                         ("error_test_id", _S), ("gcc_compile_result", _I), ("code", _S)),
    "random_c_error_records": _schema(*_MINED, *_RESULT),
    "common_c_error_records": _schema(*_MINED, *_RESULT),
}
DEFAULTS = {"similar_code": "", "modify_action_list": "", "distance": -1, "testcase": ""}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns in table order, missing ones filled with their defaults."""
    out = []
    for f in RESULT_SCHEMAS[table].fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in DEFAULTS:
                c = F.coalesce(c.cast(f.dataType), F.lit(DEFAULTS[f.name]).cast(f.dataType))
            out.append(c.cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def first_per_id(batch: DataFrame, order: list[Column], id_col: str = "id") -> DataFrame:
    """S7 (batch part): first row per id by the given order."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return batch.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def insert_ignore(batch: DataFrame, target: DataFrame | None, order: list[Column],
                  id_col: str = "id") -> DataFrame:
    """Rows of ``batch`` to append: first per id, minus ids in ``target``."""
    first = first_per_id(batch, order, id_col)
    if target is None:
        return first
    return first.join(target.select(id_col), id_col, "left_anti")


def append_ignore(spark: SparkSession, batch: DataFrame, path: str, table: str, order: list[Column]) -> int:
    """Append the new rows of a batch to the parquet table at ``path``.

    The new rows are written to a fresh staging folder first and then
    appended, so the anti join never reads the folder it writes."""
    target = spark.read.parquet(path) if table_exists(spark, path) else None
    new = conform(insert_ignore(batch, target, order), table)
    staged = materialize(spark, new, f"staged-{table}")
    staged.write.mode("append").parquet(path)
    return staged.count()


def done_keys(result: DataFrame, key: str = "problem_user_id") -> DataFrame:
    """The distinct keys already in a result table."""
    return result.select(key).distinct()


def lookup_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id list (semi join)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def chunk_rows(df: DataFrame, id_col: str, rows: int, buckets: int, seed) -> DataFrame:
    """Fixed-size chunks without a global row number: rows are hashed
    into ``buckets`` and numbered inside each bucket (a window per bucket,
    1/buckets of the data each), chunk = ``(rn - 1) / rows``."""
    b = df.withColumn("bucket", md5_mod(F.lit(buckets), seed, F.col(id_col)))
    w = Window.partitionBy("bucket").orderBy(id_col)
    return b.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / rows))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of a table (sum of per-row md5 numbers)
    and its row count; one aggregate, combined map-side."""
    return df.agg(F.sum(cell_hash_sum(*[df[f"`{c}`"] for c in df.columns])).alias("fingerprint"),
                  F.count("*").cast("bigint").alias("n_rows"))
