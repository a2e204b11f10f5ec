"""Registry of the queries (one per operator) and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables. Its
oracle is ANSI SQL over the same tables; omitted where the operation has no
SQL form (checked against a brute-force fixture in ``tests/`` instead).
Outputs are flat columns (arrays rendered as text) so both engines' results
compare cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a query under ``name`` with its oracle SQL."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
