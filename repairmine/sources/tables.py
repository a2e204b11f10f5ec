"""Readers for the input tables (one parquet file per table)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table. Column pruning and filters are left to Catalyst, which
    pushes them into the parquet reader (``ReadSchema`` / ``PushedFilters``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OPS = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "like": lambda c, v: c.like(v),
}


def condition_of(conditions) -> Column | None:
    """AND of ``(column, op, value)`` triples."""
    parts = [_OPS[op.lower()](F.col(c), v) for c, op, v in (conditions or [])]
    return reduce(lambda a, b: a & b, parts) if parts else None


def scan_where(df: DataFrame, conditions=None, columns=None) -> DataFrame:
    """Scan with an AND of simple conditions and an optional projection."""
    cond = condition_of(conditions)
    out = df if cond is None else df.where(cond)
    return out.select(*columns) if columns else out
