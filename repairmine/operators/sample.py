"""Seeded sampling, caps and splits.

Order key of every draw = md5 of ``seed|id`` (ties by id), so a sample is a
pure function of the data and the seed, survives task retries, and DuckDB
computes the same rows.

Scale: "n rows per key" must not sort a hot key in one task. Rows are first
spread over ``salts`` sub-groups by a hash of the id; each sub-group keeps
its n smallest keys (windows over 1/salts of the key), and the final pick is
over at most ``salts * n`` rows per key. This is exact: a global top-n row is
a top-n row of its own sub-group. ``n = 1`` is a plain hash aggregate
(``min(struct)``, map-side combined).

"First k distinct keys by hash" (user hold-out) avoids a global row_number:
a histogram over the first 4 hex digits (at most 65,536 rows) gives the
bucket where the cumulative count crosses k; only that bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairmine.functions.hashing import md5_key, md5_mod

DEFAULT_SALTS = 64


def cap_per_key(df: DataFrame, keys: list[str], n: int, seed, id_col: str = "id",
                salts: int = DEFAULT_SALTS) -> DataFrame:
    """At most ``n`` rows per key, chosen by the seeded md5 order."""
    cols = df.columns
    h = df.withColumn("_h", md5_key(seed, F.col(id_col)))
    if n == 1:
        best = h.groupBy(*keys).agg(F.min(F.struct("_h", id_col, *[c for c in cols if c not in keys and c != id_col]))
                                    .alias("_m"))
        return best.select(*keys, *[F.col("_m." + c).alias(c) for c in cols if c not in keys]).select(*cols)
    salted = h.withColumn("_s", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_s").orderBy("_h", id_col)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*keys).orderBy("_h", id_col)
    return stage1.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).select(*cols)


def first_k_keys(keys_df: DataFrame, key: str, k: Column, seed) -> DataFrame:
    """Distinct ``key`` values with the k smallest md5 order keys.

    ``k`` is a Column over the total count ``_n`` (e.g. ``floor(_n * 0.1)``).
    """
    u = (keys_df.select(key).distinct().where(F.col(key).isNotNull())
         .withColumn("_h", md5_key(seed, F.col(key)))
         .withColumn("_b", F.substring("_h", 1, 4)))
    hist = u.groupBy("_b").agg(F.count("*").alias("_c"))
    wc = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cum = (hist.withColumn("_before", F.coalesce(F.sum("_c").over(wc), F.lit(0)))
           .withColumn("_n", F.sum("_c").over(Window.partitionBy()))
           .withColumn("_k", k)
           .where(F.col("_before") < F.col("_k"))
           .select("_b", "_before", "_c", "_k"))
    j = u.join(cum, "_b")
    whole = j.where(F.col("_before") + F.col("_c") <= F.col("_k"))
    part = (j.where(F.col("_before") + F.col("_c") > F.col("_k"))
            .withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
            .where(F.col("_before") + F.col("_r") <= F.col("_k")))
    return whole.select(key).unionByName(part.select(key))


def holdout_keys(df: DataFrame, key: str, frac: float, seed) -> DataFrame:
    """``floor(distinct * frac)`` keys by the seeded order."""
    return first_k_keys(df, key, F.floor(F.col("_n") * F.lit(float(frac))), seed)


def split_by_keys(df: DataFrame, key: str, chosen: DataFrame, label_in: str, label_out: str) -> DataFrame:
    """Label rows whose key is in ``chosen`` (one left join, no two scans)."""
    c = chosen.select(F.col(key).alias("_k")).withColumn("_in", F.lit(True))
    return (df.join(c, df[key] == c["_k"], "left")
            .withColumn("split", F.when(F.col("_in"), F.lit(label_in)).otherwise(F.lit(label_out)))
            .drop("_k", "_in"))


def three_way_split(df: DataFrame, key: str, seed, test_frac: float = 0.1, valid_frac: float = 0.1) -> DataFrame:
    """``test`` users, then ``valid`` users among the rest, the rest ``train``."""
    test = holdout_keys(df, key, test_frac, seed)
    rest = df.select(key).distinct().join(test, key, "left_anti")
    valid = holdout_keys(rest, key, valid_frac, f"{seed}/valid")
    lab = (test.withColumn("_lab", F.lit("test"))
           .unionByName(valid.withColumn("_lab", F.lit("valid"))).withColumnRenamed(key, "_k"))
    return (df.join(lab, df[key] == lab["_k"], "left")
            .withColumn("split", F.coalesce(F.col("_lab"), F.lit("train"))).drop("_k", "_lab"))


def weighted_choice(weights, seed, *parts: Column) -> Column:
    """Index drawn with integer weights: ``u = md5 % sum``, first index
    whose cumulative weight exceeds ``u``."""
    return weighted_index(weights, md5_mod(F.lit(sum(weights)), seed, *parts))


def weighted_index(weights, u: Column) -> Column:
    """The first index whose cumulative weight exceeds ``u``."""
    expr = None
    cum = 0
    for i, w in enumerate(weights):
        cum += w
        expr = F.when(u < cum, F.lit(i)) if expr is None else expr.when(u < cum, F.lit(i))
    return expr
