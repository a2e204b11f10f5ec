"""Token-level edit distance and nearest-partner search.

A token sequence is an array of corpus-wide token ids (64-bit hashes of the
compared token values), or a string whose characters are the tokens.

Distances of id arrays (D1, D2) come from a bit-parallel kernel in Arrow
batches: no vocabulary, no limit on tokens. The nearest search compares very
many pairs, so it works on strings of one symbol a token (20 bits of the id)
with Spark's ``levenshtein`` in the JVM: tokens that fall on one symbol can
only make a distance smaller, so that is a lower bound. The winner of every
failing sequence is checked: if none of its pair's tokens share a symbol the
bound is the distance, else the kernel takes it, and if it is larger all
partners whose bound does not exceed it are compared by the kernel.

Nearest search never builds the full failing x passing product of a group:

* copies are collapsed first: distances are computed between *distinct*
  sequences of a group, and the partner of a set of equal passing sequences
  is the one with the smallest id (one group of copies may hold a third of
  the data; it costs one row here);
* a failing sequence that also passed in its group is settled by an equi-join;
* groups are split by the number of distinct pairs of the others: a small group
  (``n_fail * n_pass <= pair_limit``) is compared directly;
* in large (hot) groups a sequence has a profile: how many of its tokens fall
  into each of 32 buckets. One edit moves the length, and the number of tokens
  in any set of buckets, by one at most. For a band ``k``, the length and four
  half-sets are cut into cells of ``2 k + 1``, and pairs come from an equi-join
  on the cells; the bag distance of the profiles (a lower bound) drops most of
  them before anything is compared. A failing sequence whose best partner has
  distance ``<= k`` is settled, the others go to the next band;
* what no band settles goes best first: the partner with the least bag
  distance gives an upper bound, and only partners whose bag distance is not
  above it are compared, in the band of that bound;
* both sides of a large group, and of a cell, are cut into blocks, and pairs
  of blocks are dealt to as many tasks as their pairs make: no task holds a
  group, and more pairs make more tasks, not longer ones;
* a candidate is one long (distance, then the partner's rank by id), so the
  arg-min is a hash aggregate; the partner comes back by its rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType

from repairmine.session import materialize

# First code point of a token symbol (beyond the UTF-16
# surrogates) and the bits that are left.
SYMBOL_BASE = 0x10000
SYMBOL_MASK = 0xFFFFF

# Bands of the cell joins of large groups.
DEFAULT_BANDS = (2, 8)
# Largest distinct-pair count of a group compared without bands.
DEFAULT_PAIR_LIMIT = 4096
# Sequences of one side of a large group (or cell) that one block holds, and
# pairs that one task compares.
TILE = 512
PAIRS_A_TASK = 1_000_000
# A profile is four numbers of eight counts. A count is a run of up to eight
# one-bits, so what one profile has beyond another is a number of bits. In
# groups of long sequences a bit stands for several tokens; an edit still moves
# a count by one bit at most.
LONGS, LANES, DEPTH = 4, 8, 8
BUCKETS = LONGS * LANES
HALVES = (1, 2, 4, 8)
#: Longest sequence of a group whose bits stand for one token each.
PLAIN_LENGTH = 96


def token_ids(toks: Column, key=None) -> Column:
    """Token array -> corpus-wide ids. ``key`` (U1) maps a token Column to
    the value compared for equality; null stays null."""
    return F.transform(toks, lambda t: F.xxhash64(t if key is None else key(t)))


def edit_distance(a: np.ndarray, b: np.ndarray, bound: int | None = None) -> int:
    """Distance of two id arrays, -1 above ``bound``. Equal ends are cut; the
    rest goes through the bit-parallel recurrence of Myers, a column of the
    matrix being one integer of as many bits as the shorter side has tokens."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if bound is not None and len(b) - len(a) > bound:
        return -1
    score = len(a)
    if not score:
        return len(b)
    places: dict[int, int] = {}
    for i, t in enumerate(a.tolist()):
        places[t] = places.get(t, 0) | (1 << i)
    full, last = (1 << score) - 1, 1 << (score - 1)
    up, down, left = full, 0, len(b)
    for t in b.tolist():
        left -= 1
        eq = places.get(t, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if bound is not None and score - left > bound:
            return -1
        ph = ((ph << 1) | 1) & full
        up = ((mh << 1) & full) | (full & ~(xv | ph))
        down = ph & xv
    return score if bound is None or score <= bound else -1


def token_distance(a: Column, b: Column, bound: int | None = None) -> Column:
    """Distance of two id arrays; with ``bound``: -1 above it."""

    @F.pandas_udf("int")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q, bound) for p, q in zip(x, y)], dtype="Int32")

    return kernel(a, b)


def symbols(ids: Column) -> Column:
    """Id array -> string of one symbol a token."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else (SYMBOL_BASE + (p & SYMBOL_MASK)).astype("<u4").tobytes().decode("utf-32-le")
                          for p in x])

    return text(ids)


def checked(a: Column, b: Column, least: Column) -> Column:
    """The distance of two id arrays whose symbols have distance ``least``."""

    @F.pandas_udf("int")
    def exact(x: pd.Series, y: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for p, q, k in zip(x, y, d):
            own = set(p.tolist()) | set(q.tolist())
            same = len({t & SYMBOL_MASK for t in own}) == len(own)
            out.append(int(k) if same else edit_distance(p, q))
        return pd.Series(out, dtype="int32")

    return exact(a, b, least)


def profile(text: Column, scale: Column) -> Column:
    """Counts of a string's symbols by bucket, ``scale`` to a bit (``p0`` to
    ``p3``), and in four halves of the buckets (``h0`` to ``h3``)."""
    kind = ", ".join([*(f"p{i} long" for i in range(LONGS)), *(f"h{i} int" for i in range(len(HALVES)))])

    @F.pandas_udf(kind)
    def counts(x: pd.Series, scales: pd.Series) -> pd.DataFrame:
        c = np.array([np.bincount(np.frombuffer(s.encode("utf-32-le"), "<u4") % BUCKETS, minlength=BUCKETS) for s in x],
                     dtype=np.int64).reshape(-1, BUCKETS)
        runs = np.minimum(c // scales.to_numpy()[:, None], DEPTH)
        bits = ((np.uint64(1) << runs.astype(np.uint64)) - np.uint64(1)) << (DEPTH * (np.arange(BUCKETS) % LANES)).astype(np.uint64)
        longs = np.bitwise_or.reduce(bits.reshape(-1, LONGS, LANES), axis=2).view(np.int64)
        out = {f"p{i}": longs[:, i] for i in range(LONGS)}
        out |= {f"h{i}": c[:, np.arange(BUCKETS) & h > 0].sum(axis=1).astype(np.int32) for i, h in enumerate(HALVES)}
        return pd.DataFrame(out)

    return counts(text, scale)


# A candidate is one number, its distance above its partner's rank, so the
# arg-min is a plain minimum of longs (hash aggregate, fixed width).
_RANK_BITS = 38
_PART_BITS = 24
_NONE = (1 << 25) - 1  # what is left of -1, the distance above a bound


def _pack(d: Column) -> Column:
    return F.shiftleft(d.cast("bigint").bitwiseAND(F.lit(_NONE)), _RANK_BITS) + F.col("_rank")


def _best(cand: DataFrame) -> DataFrame:
    """Smallest (distance, partner rank) per failing sequence."""
    least = cand.groupBy("_fid").agg(F.min(_pack(F.col("_d"))).alias("_m"))
    return least.where(F.shiftright("_m", _RANK_BITS) < _NONE)


def _ranked(passing: DataFrame, keys: list[str]) -> DataFrame:
    """``passing`` with ``_rank``, in the order of the ids. Whole numbers that
    fit are their own rank; others are numbered by ranges of their order,
    without a global window."""
    if isinstance(passing.schema["_pid"].dataType, IntegralType):
        low, high = passing.agg(F.min("_pid"), F.max("_pid")).first()
        if low is None or (low >= 0 and high < 1 << _RANK_BITS):
            return passing.withColumn("_rank", F.col("_pid").cast("bigint"))
    at = F.monotonically_increasing_id()
    part, place = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (part < 1 << (_RANK_BITS - _PART_BITS)) & (place < 1 << _PART_BITS)
    r = passing.repartitionByRange("_pid", *keys).sortWithinPartitions("_pid", *keys).withColumn(
        "_rank", F.when(fits, F.shiftleft(part, _PART_BITS) + place).otherwise(
            F.raise_error(F.lit("a range of partners is too long; raise spark.sql.shuffle.partitions")).cast("bigint")))
    return materialize(passing.sparkSession, r, "ranked")


def _with_profile(df: DataFrame, text: str, to: str) -> DataFrame:
    df = df.withColumn("_p", profile(F.col(text), F.col("_scale")))
    return df.select(*[c for c in df.columns if c != "_p"], *[F.col(f"_p.{c}").alias(f"_{c}{to}") for c in (
        *(f"p{i}" for i in range(LONGS)), *(f"h{i}" for i in range(len(HALVES))))])


def _coordinates(side: str) -> list[Column]:
    """Numbers that one edit moves by one at most."""
    return [F.col(f"_l{side}"), *[F.col(f"_h{i}{side}") for i in range(len(HALVES))]]


def _beyond(x: str, y: str) -> Column:
    """What the counts of ``x`` have beyond those of ``y``, summed."""
    bits = [F.bit_count(F.col(f"_p{i}{x}").bitwiseAND(F.bitwise_not(F.col(f"_p{i}{y}")))) for i in range(LONGS)]
    return sum(bits[1:], bits[0])


def bag_distance() -> Column:
    """Lower bound of the distance from two profiles: the larger of what one
    has beyond the other."""
    return F.greatest(_beyond("a", "b"), _beyond("b", "a"))


def tasks_of(df: DataFrame, pairs: Column) -> int:
    """Tasks for the pairs that the rows of ``df`` stand for."""
    n = df.agg(F.sum(pairs)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PAIRS_A_TASK))


def met_in_blocks(fa: DataFrame, pb: DataFrame, at: list[str]) -> DataFrame:
    """All pairs that agree on ``at``. Both sides of a key are cut into blocks
    of some ``TILE`` rows, and pairs of blocks are dealt to tasks of about
    ``PAIRS_A_TASK`` pairs: few bytes, but much to compare, so neither a key
    nor a partition merged by its size may set the work of a task."""
    spark = fa.sparkSession
    both = fa.groupBy(*at).agg(F.count("*").alias("_na")).join(pb.groupBy(*at).agg(F.count("*").alias("_nb")), at)
    both = materialize(spark, both, "blocks")
    tasks = tasks_of(both, F.col("_na") * F.col("_nb"))
    cuts = both.select(*at, F.ceil(F.col("_na") / TILE).alias("_rows"), F.ceil(F.col("_nb") / TILE).alias("_tiles"))

    def cut(df, of, own, n_own, other, n_other):
        df = df.join(cuts, at).withColumn(own, F.pmod(F.xxhash64(of), F.col(n_own)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))
        return df.withColumn(other, every).drop("_rows", "_tiles").repartition(tasks, *at, "_row", "_tile")

    near, own = cut(fa, "_fid", "_row", "_rows", "_tile", "_tiles"), cut(pb, "_rank", "_tile", "_tiles", "_row", "_rows")
    return near.join(own, [*at, "_row", "_tile"]).drop("_row", "_tile")


def cell_candidates(fa: DataFrame, pb: DataFrame, keys: list[str], band: int) -> DataFrame:
    """Pairs of a group whose profiles allow a distance of at most ``band``:
    an equi-join on cells of the coordinates, every pair once."""
    width = 2 * band + 1
    cells = [f"_c{i}" for i in range(1 + len(HALVES))]
    own = pb.select("*", *[F.floor(x / width).alias(c) for c, x in zip(cells, _coordinates("b"))])
    near = fa.select("*", *[F.array_distinct(F.array(F.floor((x - band) / width), F.floor((x + band) / width))).alias(c)
                            for c, x in zip(cells, _coordinates("a"))])
    for c in cells:
        near = near.withColumn(c, F.explode(c))
    met = met_in_blocks(near, own, [*keys, *cells])
    return met.where(bag_distance() <= band).drop(*cells)


def tile_candidates(fa: DataFrame, pb: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of a group with their bag distance ``_low``, in blocks."""
    return met_in_blocks(fa, pb, keys).withColumn("_low", bag_distance())


def equal_partners(fa: DataFrame, pb: DataFrame, keys: list[str]) -> DataFrame:
    """Failing sequences that also passed in their group, with ``_m``: no
    partner is nearer, so they are never compared."""
    met = fa.select(*keys, "_fid", F.col("_a").alias("_b")).join(pb.select(*keys, "_b", "_rank"), [*keys, "_b"])
    return met.select("_fid", _pack(F.lit(0)).alias("_m"))


def nearest_partner(failing: DataFrame, passing: DataFrame, group_cols: list[str],
                    id_col: str = "id", seq_col: str = "seq", max_distance: int | None = None,
                    bands=DEFAULT_BANDS, pair_limit: int = DEFAULT_PAIR_LIMIT, pair_col: str | None = None) -> DataFrame:
    """For each failing row, the passing row of its group with the
    smallest token distance (ties: smallest id; ids are unique in a group).

    ``seq_col`` holds id arrays or symbol strings. ``max_distance`` keeps
    ``0 <= d < max_distance`` like the reference's bounded run; ``None`` is
    unbounded. Output: all failing columns plus ``similar_id``,
    ``similar_seq``, ``distance`` (-1 and nulls when there is no partner, as a
    left join), and with ``pair_col`` a number that failing rows share if their
    group and sequence, and so their partner, are the same. The distinct sequences of both sides and the result of each
    round are written once and read by what follows.
    """
    spark = failing.sparkSession
    keys = list(group_cols)
    cond = F.col(seq_col).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    coded = isinstance(failing.schema[seq_col].dataType, ArrayType)
    text = symbols if coded else lambda c: c
    pb = passing.where(cond).groupBy(*keys, F.col(seq_col).alias("_b")).agg(F.min(id_col).alias("_pid"))
    pb = materialize(spark, pb.withColumn("_tb", text(F.col("_b"))).withColumn("_lb", F.length("_tb")), "passing")
    pb = _ranked(pb, keys)
    if max_distance is not None and max_distance < 1:
        max_distance = None
    bound = None if max_distance is None else max_distance - 1

    # equal sequences are settled, the others' groups split by their distinct-pair count
    fa = failing.where(cond).select(*keys, F.col(seq_col).alias("_a")).distinct()
    fa = materialize(spark, fa.withColumn("_ta", text(F.col("_a"))).withColumn("_la", F.length("_ta")).withColumn(
        "_fid", F.monotonically_increasing_id()), "failing")
    same = materialize(spark, equal_partners(fa, pb, keys), "equal")
    rest = materialize(spark, fa.join(same.select("_fid"), "_fid", "left_anti"), "unequal")
    n_pass = pb.groupBy(*keys).agg(F.count("*").alias("_np"), F.max("_lb").alias("_longest"))
    sizes = rest.groupBy(*keys).agg(F.count("*").alias("_nf")).join(n_pass, keys).select(
        *keys, (F.col("_nf") * F.col("_np")).alias("_pairs"), (F.col("_nf") * F.col("_np") <= pair_limit).alias("_small"),
        F.ceil((F.col("_longest") + 1) / PLAIN_LENGTH).alias("_scale"))
    sizes = materialize(spark, sizes, "groups")

    least = F.levenshtein("_ta", "_tb") if bound is None else F.levenshtein("_ta", "_tb", bound)
    few = sizes.where("_small")
    tasks = tasks_of(few, F.col("_pairs"))
    small = rest.select(*keys, "_fid", "_ta").join(few.select(*keys), keys).repartition(tasks, *keys).join(
        pb.select(*keys, "_tb", "_rank").join(few.select(*keys), keys, "left_semi").repartition(tasks, *keys), keys).withColumn("_d", least)
    best = [same, _best(small)]
    large = sizes.where("not _small").select(*keys, "_scale")
    if not large.isEmpty():
        best += _search_large(rest, pb, large, keys, bands, bound)
    found = best[0]
    for b in best[1:]:
        found = found.unionByName(b)
    rank_of = F.col("_m").bitwiseAND(F.lit((1 << _RANK_BITS) - 1))
    won = (found.select("_fid", rank_of.alias("_rank"), F.shiftright("_m", _RANK_BITS).cast("int").alias("_d"))
           .join(fa.select("_fid", *keys, "_a", "_ta"), "_fid").join(pb.select(*keys, "_rank", "_pid", "_b"), [*keys, "_rank"]))
    if coded:
        won = _verified(won, pb, keys, bound)
    won = won.select(*keys, F.col("_a").alias(seq_col), "_pid", "_b", "_d", *([F.col("_fid").alias(pair_col)] if pair_col else []))
    return (failing.join(won, [*keys, seq_col], "left")
            .withColumnRenamed("_pid", "similar_id").withColumnRenamed("_b", "similar_seq")
            .withColumn("distance", F.coalesce(F.col("_d"), F.lit(-1))).drop("_d"))


def _search_large(fa: DataFrame, pb: DataFrame, large: DataFrame, keys: list[str], bands, bound: int | None) -> list[DataFrame]:
    """The rounds over large groups: ``_fid, _m`` of each round."""
    spark = fa.sparkSession
    todo = materialize(spark, _with_profile(fa.drop("_a").join(large, keys), "_ta", "a"), "profiles")
    own = materialize(spark, _with_profile(pb.drop("_pid", "_b").join(large, keys), "_tb", "b"), "profiles")
    best = []
    for band in bands:
        k = band if bound is None else min(band, bound)
        near = cell_candidates(todo, own, keys, k)
        b = materialize(spark, _best(near.withColumn("_d", F.levenshtein("_ta", "_tb", k))), "band")
        best.append(b)
        todo = materialize(spark, todo.join(b.select("_fid"), "_fid", "left_anti"), "unresolved")
        if k == bound or todo.isEmpty():
            return best
    pairs = tile_candidates(todo, own, keys)
    if bound is not None:
        pairs = pairs.where(F.col("_low") <= bound)
    first = pairs.groupBy("_fid").agg(F.min(_pack(F.col("_low"))).alias("_m")).select(
        "_fid", F.col("_m").bitwiseAND(F.lit((1 << _RANK_BITS) - 1)).alias("_rank"))
    most = F.levenshtein("_ta", "_tb") if bound is None else F.least(F.levenshtein("_ta", "_tb"), F.lit(bound))
    first = materialize(spark, first.join(todo.select("_fid", *keys, "_ta"), "_fid").join(
        own.select(*keys, "_rank", "_tb"), [*keys, "_rank"]).select("_fid", most.alias("_most")), "upper")
    todo = materialize(spark, todo.join(first, "_fid"), "bounded")
    near = tile_candidates(todo, own, keys).where("_low <= _most").withColumn("_d", F.expr("levenshtein(_ta, _tb, _most)"))
    return [*best, materialize(spark, _best(near), "rest")]


def _verified(won: DataFrame, pb: DataFrame, keys: list[str], bound: int | None) -> DataFrame:
    """Winners with the distance of their ids. Where symbols hid a difference,
    every partner whose symbols are not farther is compared by the kernel."""
    spark = won.sparkSession
    won = materialize(spark, won.withColumn("_true", checked(F.col("_a"), F.col("_b"), F.col("_d"))), "winners")
    again = won.where("_true > _d")
    fine = won.where("_true = _d").select(*keys, "_fid", "_a", "_pid", "_b", "_d")
    if again.isEmpty():
        return fine
    most = F.col("_true") if bound is None else F.least("_true", F.lit(bound))
    near = again.select(*keys, "_fid", "_a", "_ta", most.alias("_most")).join(pb.select(*keys, "_rank", "_tb", "_pid", "_b"), keys)
    near = near.where("levenshtein(_ta, _tb, _most) >= 0").withColumn("_d", token_distance(F.col("_a"), F.col("_b")))
    near = materialize(spark, near.where("_d <= _most").select(*keys, "_fid", "_a", "_rank", "_pid", "_b", "_d"), "compared")
    least = _best(near)
    return fine.union(near.withColumn("_m", _pack(F.col("_d"))).join(least, ["_fid", "_m"]).select(*keys, "_fid", "_a", "_pid", "_b", "_d"))
