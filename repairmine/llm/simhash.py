"""SimHash near-dedup: meet-in-the-middle ball hashing (operator 6).

A fingerprint has a bit for every bit that over half of a text's shingle
hashes have set. Two fingerprints at ``max_bits`` (even) or fewer differing
bits have a value between them at half that distance from each. So every
distinct fingerprint emits all its variants within half the radius, and
fingerprints that share a variant meet. Variants are shuffled by their first
``bits`` bits: the flips among those are rows, the flips among the rest are
expanded where the rows arrive (a row stands for up to a thousand variants).
All that share a variant are within ``max_bits`` of each other, so linking
each to the smallest one loses no connection and a bucket of n costs n links,
not n * n. Links are deduplicated and verified, then joined to components.

Defined results: a text without words (null, empty, blank) has fingerprint
zero and links like any other; under ``shingle`` words the whole sequence is
the one shingle; rows are documents of their own, also when equal; null ids
count for no smallest id; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import forget
from .common import key_groups, written
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Variants that a task expands at once; a larger bucket is split by further bits.
EXPANDED = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z and space, 9 to 13 only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), parts), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 4096):
        bits = np.unpackbits(h[a:a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def flips(first: int, last: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of all flips of up to ``most`` of the bits
    ``first`` to ``last - 1``."""
    return [(sum(1 << b for b in c), k) for k in range(most + 1) for c in combinations(range(first, last), k)]


def meet(fps: np.ndarray, used: np.ndarray, low: int, radius: int) -> list[np.ndarray]:
    """Links (n x 2) among fingerprints whose variants agree above bit
    ``low`` after ``used`` flips there, over the variants of the rest."""
    masks = [flips(0, low, radius - j) for j in range(radius + 1)]
    n = sum(int((used == j).sum()) * len(masks[j]) for j in range(radius + 1))
    if n > EXPANDED and low > 4:
        out, step = [], 4
        for value in range(1 << step):
            at = low - step
            away = ((fps >> np.uint64(at)) & np.uint64(15)) ^ np.uint64(value)
            spent = used + np.array([bin(x).count("1") for x in range(16)])[away.astype(np.int64)]
            near = spent <= radius
            if near.sum() > 1:
                out += meet(fps[near], spent[near], at, radius)
        return out
    keep = np.uint64((1 << low) - 1)
    values, owners = [], []
    for j in range(radius + 1):
        own = fps[used == j]
        if len(own):
            m = np.array([x for x, _ in masks[j]], dtype=np.uint64)
            values.append(((own & keep)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own, len(m)))
    if not values:
        return []
    z, own = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(z, kind="stable")
    z, own = z[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(z))))
    link = own != least
    return [np.unique(np.stack([own[link], least[link]], axis=1), axis=0)] if link.any() else []


def ball_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct fingerprints
    (column ``fp``, long) at ``max_bits`` or fewer differing bits."""
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    radius = max_bits // 2
    n = prints.count()
    bits = min(24, max(8, math.ceil(math.log2(n / 64 + 1))))
    low = 64 - bits
    signed = [(m - (1 << 64) if m >> 63 else m, k) for m, k in flips(low, 64, radius)]
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("used")) for m, k in signed])
    rows = prints.select("fp", F.explode(masks).alias("m")).select(
        F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m.mask")), low).alias("bucket"), "fp", "m.used")

    def links(batches):
        for t in key_groups(batches, "bucket"):
            if t.num_rows < 2:
                continue
            fps = t.column("fp").to_numpy().view(np.uint64)
            found = meet(fps, t.column("used").to_numpy(), low, radius)
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64))
                                                  for i in (0, 1)], names=["a", "b"])

    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(links, "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def components_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id, th`` (hash of the text) ``, fp, component`` (a fingerprint) of every row."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        forget()
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.col(f"`{text_col}`")
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
                               prints(text).alias("fp")), "fingerprints")
    of = components(ball_links(written(rows.select("fp").distinct(), "distinct-fingerprints"), max_bits))
    return written(rows.join(of, rows["fp"] == of["node"], "left").select(
        "doc_id", "th", "fp", F.coalesce("component", "fp").alias("component")), "members")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (the smallest
    id reachable by links) for every row."""
    rows = components_of(docs, id_col, text_col, shingle, max_bits)
    # written, so that AQE may split a hot component in the join
    least = written(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(least, "component").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                                "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that lead their component: smallest id (null
    last), then smallest text hash; of rows equal in both, one."""
    rows = components_of(docs, id_col, text_col, shingle, max_bits)
    one = rows.groupBy("component", "doc_id", "th").agg(F.count("*").alias("__n"))
    lead = one.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "__n")).alias("x"))
    lead = written(lead.select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"), F.col("x.__n").alias("__n")),
                   "leaders")
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    kept = docs.select("*", th.alias("__own")).join(
        lead, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th"))).drop("__id", "__th")
    single = kept.where("__n = 1")
    if not lead.where("__n > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(f"`{id_col}`", "__own").orderBy(F.lit(0)))
        single = single.unionByName(kept.where("__n > 1").withColumn("__k", number).where("__k = 1").drop("__k"))
    return single.drop("__own", "__n")
