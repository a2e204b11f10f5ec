"""Conversation prefix trie: centroid decomposition (operator 11).

A node is a distinct sequence of first turns. Turns become two 64-bit marks as
soon as they are scanned; the key of a prefix is the xor of its turns' marks,
each mixed with its place, so keys come from running sums in slices and no
task holds a conversation. (Two prefixes are one node if both 64-bit keys
agree.)

Every conversation adds ``length - depth + 1`` to each node on its way, so the
weight of a node's subtree (conversation turns at or below it) comes out of
the grouping that makes the nodes. Roll-up over the parent edges:

1. All nodes are one component. In a component of weight T the nodes with
   more than T / 2 form one path from its top; the last one, with the least
   weight, is the centroid.
2. The centroid splits its component: each of its children tops a new one,
   what hangs elsewhere keeps the old. Which of them a node belongs to is one
   look-up in the turns of the node's smallest member, at the depth below the
   centroid.
3. The totals of what hangs at the centroid are aggregated by component and
   added to the nodes of the centroid-to-top path, whose weights lose the
   centroid's. The centroid is settled.

Weights halve with each level, so a chain of any depth takes a logarithmic
number of levels. Components of at most ``PART`` nodes are finished in the
same way inside a task.

Defined results: rows without a conv_id are no conversation; null role and
text are empty; rows with equal turn are ordered by role and text, repeated
rows are turns of their own; an empty table gives no nodes; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_groups, written

#: Nodes of a component that one task finishes.
PART = 50_000
#: Turns of a conversation whose keys one window runs over.
SLICE = 4096
#: Bytes of ids that are joined before they are hashed.
PIECE = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def marked_turns(turns: DataFrame) -> DataFrame:
    """``conv, place`` (from 1), ``t1, t2`` (marks of role and text), ``chars``
    of every turn. Rows are dealt by ranges of the order itself, so a long
    conversation runs over several tasks; its places continue from the counts
    of the ranges before."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", at.alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.length("text").alias("chars"))
    rows = written(rows, "turns").withColumn("range", F.shiftright("at", 33))
    pieces = rows.groupBy("conv", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(pieces, ["conv", "range"]).select(
        "conv", (F.col("at") + F.col("shift") + 1).alias("place"), "t1", "t2", "chars")


def borrow_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (at most ``longest``) are
    replaced by those of conversation ``base`` (both expressions over
    ``conv``): ``conv, depth, len, t1, t2, chars`` of all turns, and ``conv,
    len`` of all conversations."""
    size = written(turns.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", base.alias("base"), head.alias("head")), "conversations")
    lent = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = written(size.join(size.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv", "base", "head", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len")),
        "rebuilt")
    own = turns.join(convs, "conv").where("place > head").select(
        "conv", (F.col("place") - F.col("head") + F.col("lent")).alias("depth"), "len", "t1", "t2", "chars")
    heads = turns.where(F.col("place") <= longest).withColumnRenamed("conv", "base").join(convs, "base").where(
        "place <= head").select("conv", F.col("place").alias("depth"), "len", "t1", "t2", "chars")
    return own.union(heads), convs.select("conv", "len")


def prefix_keys(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, len, chars``, the key (``k1, k2``) of the first ``depth``
    turns and that of the prefix before (``p1, p2``), with a row of depth 0
    for every conversation."""
    z = [F.xxhash64("t1", "depth"), F.xxhash64("t2", "depth")]
    rows = written(turns.select("conv", "depth", "len", "chars", z[0].alias("z1"), z[1].alias("z2"),
                                F.floor((F.col("depth") - 1) / SLICE).alias("slice")), "marks")
    inside = Window.partitionBy("conv", "slice").orderBy("depth")
    run = rows.select("conv", "depth", "len", "chars", "slice", "z1", "z2",
                      F.bit_xor("z1").over(inside).alias("k1"), F.bit_xor("z2").over(inside).alias("k2"))
    # conversations of more than one slice continue from the slices before
    total = rows.where("len > %d" % SLICE).groupBy("conv", "slice").agg(
        F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    past = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("conv", "slice", F.bit_xor("s1").over(past).alias("b1"), F.bit_xor("s2").over(past).alias("b2"))
    later = run.where("slice > 0").join(total, ["conv", "slice"]).select(
        "conv", "depth", "len", "chars", "slice", "z1", "z2", F.col("k1").bitwiseXOR(F.col("b1")).alias("k1"),
        F.col("k2").bitwiseXOR(F.col("b2")).alias("k2"))
    keyed = run.where("slice = 0").union(later).select(
        "conv", "depth", "len", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), "len", F.lit(0).alias("chars"), zero.alias("k1"), zero.alias("k2"),
                        none.alias("p1"), none.alias("p2"))
    return written(keyed.unionByName(root), "prefixes")


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row a node: its key, parent's key, ``conv`` (smallest member),
    ``depth, n_convs, n_children, saved`` (its own) and ``weight`` of its subtree."""
    nodes = written(prefixes.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
        F.max("chars").alias("chars")), "nodes")
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    return written(nodes.join(children, ["k1", "k2"], "left").select(
        "k1", "k2", "p1", "p2", "conv", "depth", "n_convs", "weight",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "trie")


_STATE = ["k1", "k2", "p1", "p2", "conv", "depth", "c1", "c2", "weight", "leaves", "saved", "add_leaves", "add_saved"]


def roll_up(nodes: DataFrame, paths: DataFrame, part: int = PART) -> DataFrame:
    """``k1, k2, n_leaves, saved_tokens``: totals over every node's subtree.
    ``paths`` holds the keys of all prefixes of all conversations."""
    zero = F.lit(0).cast("long")
    alive = nodes.select(
        "k1", "k2", "p1", "p2", "conv", "depth", zero.alias("c1"), zero.alias("c2"), "weight",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved",
        zero.alias("add_leaves"), zero.alias("add_saved"))
    settled, small = [], []
    while True:
        alive = written(alive, "alive")
        size = alive.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("weight").alias("whole"))
        large = written(size.where(F.col("n") > part).select("c1", "c2", "whole"), "components")
        if large.isEmpty():
            small.append(alive)
            break
        small.append(alive.join(large, ["c1", "c2"], "left_anti").select(_STATE))
        rows = alive.join(large, ["c1", "c2"])
        centre = written(rows.where("2 * weight > whole").groupBy("c1", "c2").agg(
            F.min(F.struct("weight", "k1", "k2", "depth")).alias("x")).select(
            "c1", "c2", F.col("x.k1").alias("x1"), F.col("x.k2").alias("x2"), F.col("x.depth").alias("at"),
            F.col("x.weight").alias("cut")), "centroids")
        rows = written(rows.join(centre, ["c1", "c2"]), "parted")
        # above the centroid's depth nothing hangs at it; below, the node's
        # smallest member tells which of its children (if any) leads there
        below = paths.select(F.col("conv"), F.col("depth").alias("turn"), F.col("k1").alias("y1"), F.col("k2").alias("y2"),
                             F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        rows = rows.withColumn("turn", F.col("at") + 1)
        deep = rows.where("depth > at").join(below, ["conv", "turn"]).withColumn(
            "under", (F.col("q1") == F.col("x1")) & (F.col("q2") == F.col("x2")))
        flat = rows.where("depth <= at").withColumns({"y1": F.lit(None).cast("long"), "y2": F.lit(None).cast("long"),
                                                      "under": (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))})
        rows = written(deep.drop("q1", "q2").unionByName(flat), "labelled")
        total = written(rows.where("under").groupBy("c1", "c2").agg(
            F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved")), "totals")
        rows = rows.join(total, ["c1", "c2"])
        is_centre = F.col("under") & F.col("y1").isNull()
        settled.append(rows.where(is_centre).select(
            "k1", "k2", (F.col("add_leaves") + F.col("t_leaves")).alias("n_leaves"),
            (F.col("add_saved") + F.col("t_saved")).alias("saved_tokens")))
        path = ~F.col("under") & (2 * F.col("weight") > F.col("whole"))
        plus = lambda c, t: (F.col(c) + F.when(path, F.col(t)).otherwise(0)).alias(c)
        # the label of what hangs at a child is the child
        alive = rows.where(~is_centre).select(
            "k1", "k2", "p1", "p2", "conv", "depth", F.when(F.col("under"), F.col("y1")).otherwise(F.col("c1")).alias("c1"),
            F.when(F.col("under"), F.col("y2")).otherwise(F.col("c2")).alias("c2"),
            (F.col("weight") - F.when(path, F.col("cut")).otherwise(0)).alias("weight"), "leaves", "saved",
            plus("add_leaves", "t_leaves"), plus("add_saved", "t_saved"))
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)

    def finish(batches):
        for t in key_groups(batches, "c1"):
            yield settle({c: t.column(c).to_pylist() for c in
                          ("k1", "k2", "p1", "p2", "weight", "leaves", "saved", "add_leaves", "add_saved")})

    out = rest.drop("conv", "depth").repartition("c1").sortWithinPartitions("c1").mapInArrow(
        finish, "k1 long, k2 long, n_leaves long, saved_tokens long")
    for s in settled:
        out = out.unionByName(s)
    return out


def settle(g: dict) -> pa.RecordBatch:
    """The same decomposition for the nodes of bounded components, in memory."""
    n = len(g["k1"])
    weight, leaves, saved = g["weight"], g["leaves"], g["saved"]
    n_leaves, n_saved = g["add_leaves"], g["add_saved"]  # become the totals
    if n == 1:
        n_leaves, n_saved = [n_leaves[0] + leaves[0]], [n_saved[0] + saved[0]]
    else:
        at = {k: i for i, k in enumerate(zip(g["k1"], g["k2"]))}
        up = [at.get(p, -1) for p in zip(g["p1"], g["p2"])]
        children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(up):
            if p >= 0:
                children[p].append(i)
        apart = [p < 0 for p in up]  # tops of components, and centroids
        todo = [i for i in range(n) if apart[i]]
        while todo:
            top = todo.pop()
            whole, x, path = weight[top], top, []
            while True:
                heavy = next((c for c in children[x] if not apart[c] and 2 * weight[c] > whole), None)
                if heavy is None:
                    break
                path.append(x)
                x = heavy
            t_leaves = t_saved = 0
            reach = [x]
            while reach:
                u = reach.pop()
                t_leaves += leaves[u]
                t_saved += saved[u]
                reach += [c for c in children[u] if not apart[c]]
            for u in path:
                n_leaves[u] += t_leaves
                n_saved[u] += t_saved
                weight[u] -= weight[x]
            n_leaves[x] += t_leaves
            n_saved[x] += t_saved
            for c in children[x]:
                if not apart[c]:
                    apart[c] = True
                    todo.append(c)
            apart[x] = True
            if path:
                todo.append(top)
    return pa.RecordBatch.from_arrays([pa.array(g["k1"], pa.int64()), pa.array(g["k2"], pa.int64()),
                                       pa.array(n_leaves, pa.int64()), pa.array(n_saved, pa.int64())],
                                      names=["k1", "k2", "n_leaves", "saved_tokens"])


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes where conversations end: the ids,
    ascending, comma-joined. Ranges of the ids of a node are joined to strings
    in parallel; what one task hashes in order are those strings, streamed."""
    ends = prefixes.where("depth = len").select("k1", "k2", "conv")

    def joined(batches):
        held: list = []
        key, first, size = None, 0, 0

        def row():
            return key[0], key[1], first, ",".join(held)

        out = []
        for b in batches:
            for k1, k2, conv in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (k1, k2) or size > PIECE:
                    if held:
                        out.append(row())
                    key, first, held, size = (k1, k2), conv, [], 0
                held.append(str(conv))
                size += 12
            if len(out) > 1000:
                yield as_batch(out)
                out = []
        if held:
            out.append(row())
        if out:
            yield as_batch(out)

    def as_batch(out):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())], names=["k1", "k2", "first", "ids"])

    def hashed(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if key == (k1, k2):
                    sha.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield done(out)
        if key is not None:
            yield done([(*key, sha.hexdigest())])

    def done(out):
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.string())], names=["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        joined, "k1 long, k2 long, first long, ids string")
    return strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(
        hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, part: int = PART) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` of every node of the trie over ``turns``
    (``conv, depth, len, t1, t2, chars``) and ``convs`` (``conv, len``)."""
    prefixes = prefix_keys(turns, convs)
    nodes = trie_nodes(prefixes)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    return (nodes.join(parents, ["p1", "p2"], "left").join(roll_up(nodes, prefixes, part), ["k1", "k2"])
            .join(end_hashes(prefixes), ["k1", "k2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
