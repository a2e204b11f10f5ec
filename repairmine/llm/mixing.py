"""Mixing sources to target weights: weighted fair queueing (operator 9).

Each source gets a target of words by its weight, at most ``repeats`` times
what it holds; what a full source leaves goes to the others by weight. Its
documents queue up in a seeded shuffle, once an epoch, ``repeats`` epochs
deep. A queued copy's virtual finish time is the source's words up to and
with it, divided by the source's target, so all sources advance together
and reach time 1 when their target is met. Copies are range-sorted on that
time over all sources and cut off where the running sum of words meets the
total budget.

Everything is DataFrame code. Rows equal in source and shuffle key are one
weighted entry, so copies of one row cost one row. Running sums are taken
in two steps: sums of slices (a source's shuffle order and the global time
line, both cut into equal slices), then windows inside a slice, so no window
holds a whole source. Virtual times advance by words, so slices of equal
time hold about equal words.

Defined results: a null text has size 0; a document of size 0 queues like any
other and adds nothing; sources are ordered by code point with null last;
if no source holds a word nothing is taken; the shuffle key is made of id and
text, so reruns agree, and equal rows are told apart only by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, put, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Rows that a slice of a running sum holds on average.
SLICE_ROWS = 2_000
#: Slices that one window adds up; more are added up in levels.
WIDE = 4096
#: Equal rows that queue as one entry.
EQUAL_RUN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` of a table ``source, source_size``.

    Sources fill up in the order of capacity over weight; the first one that
    its fair share of what is left does not fill sets the level for all
    after it."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "place")
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    on = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (sizes.withColumn("place", F.row_number().over(by_code))
         .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            ((F.col("place") - 1) % len(weights) + 1).cast("int")))
         .withColumn("capacity", F.col("source_size") * float(repeats))
         .withColumn("ratio", F.col("capacity") / F.col("weight"))
         .withColumn("left", F.sum("source_size").over(Window.partitionBy()) * share
                     - F.coalesce(F.sum("capacity").over(ahead), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.sum("weight").over(on))
         .withColumn("open", F.col("level") < F.col("ratio")))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.select("source", "source_size", F.coalesce(
        F.least(F.col("weight") * level, F.col("capacity")), F.col("capacity")).alias("target"))


def slices_before(sums: DataFrame, keys: list[str], slice_col: str, last: int, wide: int = WIDE) -> DataFrame:
    """``sums`` (``__sum`` of each slice, numbered 0 to ``last``) with
    ``__before``, the sum of the slices ahead of it. Runs of ``wide`` slices
    are summed as slices of a level above, until one run holds all: a window
    never meets more than ``wide`` rows."""
    ahead = lambda *by: F.coalesce(F.sum("__sum").over(
        Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if last < wide:
        return sums.withColumn("__before", ahead(*keys))
    up = f"{slice_col}_up"
    own = sums.withColumn(up, F.expr(f"`{slice_col}` div {wide}")).withColumn("__inside", ahead(*keys, up))
    above = slices_before(own.groupBy(*keys, up).agg(F.sum("__sum").alias("__sum")), keys, up, last // wide, wide)
    return (own.join(above.drop("__sum"), [*keys, up])
            .withColumn("__before", F.col("__before") + F.col("__inside")).drop("__inside", up))


def running(rows: DataFrame, keys: list[str], slice_col: str, last: int, order: list, amount: str, name: str,
            wide: int = WIDE) -> DataFrame:
    """Sum of ``amount`` up to and with each row, in the order of slices
    (numbered 0 to ``last``) and of ``order`` inside them."""
    before = slices_before(rows.groupBy(*keys, slice_col).agg(F.sum(amount).alias("__sum")), keys, slice_col, last, wide)
    inside = F.sum(amount).over(Window.partitionBy(*keys, slice_col).orderBy(*order)
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(before.drop("__sum"), [*keys, slice_col])
            .withColumn(name, F.col("__before") + inside).drop("__before"))


def with_queue_key(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with ``__source`` (null as its own key) and ``__key``, ``__tie``
    (two 64-bit hashes of id and text: the seeded shuffle)."""
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("string")
    return docs.select(
        "*", F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("__source"),
        F.xxhash64(F.lit(seed), key, text).alias("__key"), F.xxhash64(text, key, F.lit(seed)).alias("__tie"))


ENTRY = ["__source", "__key", "__tie"]


def fair_queue(entries: DataFrame, plan: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The taken part of the queue. ``entries``: ``__source, __key, __tie, __size,
    __copies`` (how many rows are equal); ``plan``: ``__source, target, __rows``. Returns
    ``__source, __key, __tie, __size, epoch, finish, position, taken``: ``taken``
    of the entry's rows go in at this epoch, and ``position`` counts the words
    of the mix up to their end. Many equal rows queue in runs of
    ``EQUAL_RUN``, so they spread over the shuffle like other rows."""
    slices = max(1, -(-entries.count() * repeats // SLICE_ROWS))
    last_lane, last_span = slices + 2 * repeats, 4 * repeats * slices
    q = (entries.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
         .withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"cast((__copies - 1) div {EQUAL_RUN} as int)"))))
         .withColumn("__copies", F.least(F.lit(EQUAL_RUN), F.col("__copies") - F.col("run") * EQUAL_RUN))
         .withColumn("words", F.col("__size") * F.col("__copies"))
         # the shuffle of an epoch: another mix of the same key
         .withColumn("turn", F.xxhash64("epoch", "run", "__key"))
         .join(plan.select("__source", "target", "__rows"), "__source").where(F.col("target") > 0))
    # a source's shuffle order falls into lanes by its own number of rows
    lanes = F.ceil(F.col("__rows") / SLICE_ROWS)
    q = q.withColumn("lane", F.col("epoch") * lanes + F.shiftrightunsigned("turn", 33) % lanes)
    q = running(q, ["__source"], "lane", last_lane, ["turn", "__key", "__tie", "run"], "words", "served")
    q = q.withColumn("finish", F.col("served") / F.col("target"))
    q = q.withColumn("span", F.least(F.floor(F.col("finish") * slices), F.lit(last_span)).cast("long"))
    q = written(q.drop("lane", "served", "target", "__rows"), "queue")
    placed = running(q.repartitionByRange("span"), [], "span", last_span,
                     ["finish", "__source", "epoch", "turn", "__key", "__tie", "run"], "words", "position")
    budget = F.lit(float(plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]))
    # one entry crosses the budget: its rows go in while the larger part fits
    start = F.col("position") - F.col("words")
    fits = F.when(F.col("__size") == 0, F.when(start < budget, F.col("__copies")).otherwise(0)).otherwise(
        F.floor((budget - start) / F.col("__size") + 0.5))
    return (placed.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("__copies"), fits)).cast("long"))
            .where("taken > 0").drop("words", "span", "turn", "run", "__copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` (of
    its source) and ``times`` (how often the mix takes it, 0 to ``repeats``)."""
    keyed = with_queue_key(docs, id_col, text_col, source_col, seed)
    entries = written(keyed.withColumn("__size", word_count(F.col(f"`{text_col}`"))).groupBy(*ENTRY)
                      .agg(F.max("__size").alias("__size"), F.count("*").alias("__copies")), "entries")
    sizes = entries.groupBy("__source").agg(
        F.sum(F.col("__size") * F.col("__copies")).alias("source_size"), F.count("*").alias("__rows"))
    plan = written(
        targets(sizes.select(F.when(F.col("__source") != "n", F.expr("substring(__source, 2)")).alias("source"),
                             "source_size"), weights, share, repeats)
        .select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__source"),
                F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
        .join(sizes.select("__source", "__rows"), "__source"), "targets")
    queue = fair_queue(entries, plan.withColumnRenamed("__target", "target"), repeats)
    taken = queue.groupBy(*ENTRY).agg(F.sum("taken").alias("__taken"))
    told = entries.join(taken, ENTRY, "left").join(plan, "__source").withColumn("__taken", F.coalesce("__taken", F.lit(0)))
    rows = keyed.join(told, ENTRY)
    # all rows of an entry go in equally often, but for the entry at the cut
    cut = F.col("__taken") % F.col("__copies") != 0
    number = F.row_number().over(Window.partitionBy(*ENTRY).orderBy(F.lit(0)))
    even = rows.where(~cut).withColumn("__times", F.expr("__taken div __copies"))
    uneven = rows.where(cut).withColumn("__n", number).withColumn(
        "__times", F.expr("__taken div __copies + if(__n <= __taken % __copies, 1, 0)")).drop("__n")
    both = even.unionByName(uneven)
    return put(both, size=F.col("__size"), source_size=F.col("__source_size"), target=F.col("__target"),
               times=F.col("__times").cast("int")).drop(*ENTRY, "__size", "__source_size", "__target", "__taken", "__copies",
                                                       "__rows", "__times")


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed documents themselves: each as often as it was taken."""
    return mixed.where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*columns)
