"""Seeded, engine-independent draws and fingerprints.

Every random choice in the engine is a function of md5 over
``seed|part|part...``: results repeat for a seed, do not depend on
partitioning or task retries (so a lost executor recomputes the same
values), and DuckDB computes the same numbers, which makes them checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *parts) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def md5_key(seed, *parts: Column) -> Column:
    """Hex md5 of ``seed|p1|p2...``; the order key of a seeded sample."""
    return F.md5(_key(seed, *parts))


def md5_int(seed, *parts: Column) -> Column:
    """Non-negative 32-bit integer from the first 8 hex digits of the md5.

    DuckDB form: ``('0x' || substr(md5(k), 1, 8))::BIGINT``.
    """
    return F.conv(F.substring(md5_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def md5_mod(n: Column, seed, *parts: Column) -> Column:
    """Uniform draw in ``[0, n)``."""
    return F.pmod(md5_int(seed, *parts), n.cast("bigint"))


def cell_hash_sum(*cols: Column) -> Column:
    """S12 building block: md5 of one row's cells, as a decimal number from the
    first 12 hex digits, to be summed order-free over a table."""
    row = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
    return F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
