"""Sharding: K-d tree partitioning (operator 1).

Rows are points whose dimensions are metadata columns. A node over
``sqrt(2)`` times the target bytes is split at the weighted median (weight:
bytes) of its widest dimension, width being its extent over the extent of
all rows. The levels of the tree are built for all nodes at once; medians are
found by distributed histograms that are refined inside the bucket that
crosses the middle, first on the dimension, then, among equal values, on a
hash of the row. A split ends when its halves differ by less than
``TOLERANCE`` of the node or the bucket holds a single point. The driver sees
histogram buckets only: ``BUCKETS`` a node and pass, fewer (and more passes)
where over 64 nodes are split at once.

A row finds its node by walking down the tree, which is a few constant arrays
in the plan, without a shuffle: one step a level, whatever the number of
leaves. Slots
number the rows of a shard: rows are spread by hash over slices of about
``SLICE_ROWS`` rows, which are numbered apart and then shifted.

Defined results: null text has no bytes (a row weighs its bytes plus 1);
null values of a dimension sort first; text dimensions compare by their first
six bytes, the rest falls to the row hash; rows equal in every flat column
go to one shard; an empty table has one empty leaf; input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repairmine.session import scratch_path

from .common import put, written

BUCKETS = 1024
TOLERANCE = 2e-4
SLICE_ROWS = 1000


def row_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def coordinate(df: DataFrame, name: str) -> Column:
    """A dimension as a double: numbers and times as they are, text by its
    first six bytes; null below everything."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.substring(F.hex(F.substring(c.cast("binary"), 1, 6)), 1, 12), 12, "0")
        v = F.conv(head, 16, 10).cast("double")
    elif isinstance(kind, T.NumericType):
        v = c.cast("double")
    else:
        v = F.unix_micros(c.cast("timestamp")).cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    return F.coalesce(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), v)), F.lit(-1.7e308))


def tie_of(df: DataFrame) -> Column:
    """A number in [0, 1) from a hash of the row's flat columns."""
    flat = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(
        f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return F.shiftrightunsigned(F.xxhash64(*flat), 11).cast("double") / float(1 << 53)


def constants(values: list, kind: str = "double") -> Column:
    """A constant array (folded by the optimizer), however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Tree:
    """Nodes by number: a cut ``(dimension, value, tie)`` and the two nodes
    below it, or none for a leaf."""

    def __init__(self, dimensions: int):
        self.dimensions, self.cuts, self.below, self.depth = dimensions, [None], [None], 0

    def split(self, node: int, cut: tuple) -> list[int]:
        new = [len(self.cuts), len(self.cuts) + 1]
        self.cuts[node], self.below[node] = cut, new
        self.cuts += [None, None]
        self.below += [None, None]
        return new

    def leaves(self) -> list[int]:
        """From left to right."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.below[node] is None:
                out.append(node)
            else:
                todo += self.below[node][::-1]
        return out

    def node(self) -> Column:
        """The number of the bottom node of a row."""
        if self.depth == 0:
            return F.lit(0)
        dim, value, tie = (constants([c[i] if c else d for c in self.cuts], k)
                           for i, (d, k) in enumerate(((-1, "int"), (0.0, "double"), (0.0, "double"))))
        low, high = (constants([b[i] if b else 0 for b in self.below], "int") for i in range(2))
        x = self.coordinates()

        def step(k: Column, _: Column) -> Column:
            d, v = F.element_at(dim, k + 1), F.element_at(value, k + 1)
            own = F.get(x, d)
            left = (own < v) | ((own == v) & (F.col("__tie") < F.element_at(tie, k + 1)))
            return F.when(d < 0, k).when(left, F.element_at(low, k + 1)).otherwise(F.element_at(high, k + 1))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step)

    def coordinates(self) -> Column:
        return F.array(*[F.col(f"__d{i}") for i in range(self.dimensions)])

    def by_node(self, told: dict[int, float], default: float, kind: str = "double") -> Column:
        """A constant of the row's node, which stands in ``__k``."""
        return F.element_at(constants([told.get(i, default) for i in range(len(self.cuts))], kind), F.col("__k") + 1)


def medians(points: DataFrame, tree: Tree, nodes: list[int], dims: list[int], stats: list[dict]) -> list[tuple | None]:
    """A cut ``(dimension, value, tie)`` for every node, None if its rows are one point."""
    found: list[tuple | None] = [None] * len(nodes)
    # the range that is searched: by value, or by tie among equal values
    # ("next": the first point above that range)
    search = [{"lo": s["lo"], "hi": s["hi"], "before": 0, "at": None, "next": None} for s in stats]
    todo = [i for i in range(len(nodes)) if stats[i]["lo"] < stats[i]["hi"] or stats[i]["tie_lo"] < stats[i]["tie_hi"]]
    for i in todo:
        if not stats[i]["lo"] < stats[i]["hi"]:
            search[i] |= {"at": stats[i]["lo"], "lo": stats[i]["tie_lo"], "hi": stats[i]["tie_hi"], "next": math.inf}
    while todo:
        told = lambda f, default=math.nan, kind="double": tree.by_node({nodes[i]: f(i) for i in todo}, default, kind)
        at, lo = told(lambda i: math.nan if search[i]["at"] is None else search[i]["at"]), told(lambda i: search[i]["lo"])
        hi, width = told(lambda i: search[i]["hi"]), told(lambda i: search[i]["hi"] - search[i]["lo"])
        own = F.get(tree.coordinates(), told(lambda i: dims[i], 0, "int"))
        buckets = max(16, min(BUCKETS, 64 * BUCKETS // len(todo)))
        # nothing compares as below or at NaN: nodes that are not searched drop out
        seen = (points.withColumn("__k", tree.node())
                .withColumn("x", F.when(F.isnan(at), own).otherwise(F.when(own == at, F.col("__tie"))))
                .where((F.col("x") >= lo) & (F.col("x") <= hi))
                .withColumn("p", F.when(width <= 0, F.lit(0.0)).otherwise((F.col("x") - lo) / width)))
        bucket = F.least(F.lit(buckets - 1), F.floor(F.col("p") * buckets)).cast("int")
        rows = {}
        for r in seen.groupBy(F.col("__k").alias("k"), bucket.alias("b")).agg(
                F.sum("__bytes").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            rows.setdefault(r["k"], []).append(r)
        left = []
        for i in todo:
            s, total = search[i], stats[i]["bytes"]
            hist = sorted(rows[nodes[i]], key=lambda r: r["b"])
            at = s["before"]
            for j, r in enumerate(hist):
                if 2 * (at + r["w"]) >= total or j == len(hist) - 1:
                    break
                at += r["w"]
            # cut before bucket j, or behind it
            behind = hist[j + 1]["lo"] if j + 1 < len(hist) else s["next"]
            edges = [(abs(2 * at - total), r["lo"], s["at"])] if at > 0 else []
            if behind is not None and at + r["w"] < total:
                edges.append((abs(2 * (at + r["w"]) - total), behind, s["at"]))
            best = min([*edges, *([s["best"]] if s.get("best") else [])], key=lambda e: e[0], default=None)
            if best is None or best[0] > TOLERANCE * total:
                if r["lo"] < r["hi"]:
                    search[i] = {"lo": r["lo"], "hi": r["hi"], "before": at, "at": s["at"], "next": behind, "best": best}
                    left.append(i)
                    continue
                if s["at"] is None:  # one value holds the middle: search among its ties
                    search[i] = {"lo": 0.0, "hi": 1.0, "before": at, "at": r["lo"], "next": math.inf, "best": best}
                    left.append(i)
                    continue
            if best:
                # by value: rows below the edge; by tie: also the value's lower ties
                _, edge, value = best
                found[i] = (dims[i], edge, 0.0) if value is None else (dims[i], value, 2.0 if edge == math.inf else edge)
        todo = left
    return found


def fit(points: DataFrame, dimensions: int, target_bytes: float) -> Tree:
    """The tree over ``points`` (``__d0.., __tie, __bytes``)."""
    tree, nodes, extent = Tree(dimensions), [0], None
    most = target_bytes * math.sqrt(2)
    while nodes:
        aggs = [F.sum("__bytes").alias("bytes"), F.min("__tie").alias("tie_lo"), F.max("__tie").alias("tie_hi")]
        for d in range(dimensions):
            aggs += [F.min(f"__d{d}").alias(f"lo{d}"), F.max(f"__d{d}").alias(f"hi{d}")]
        at = points.withColumn("__k", tree.node()).where(tree.by_node(dict.fromkeys(nodes, 1), 0, "int") == 1)
        got = {r["__k"]: r for r in at.groupBy("__k").agg(*aggs).collect()}
        if extent is None:
            r = got.get(0)
            extent = [(r[f"hi{d}"] - r[f"lo{d}"]) if r else 0.0 for d in range(dimensions)]
        large, dims, stats = [], [], []
        for node in nodes:
            r = got.get(node)
            if r is None or r["bytes"] <= most:
                continue
            width = [(r[f"hi{d}"] - r[f"lo{d}"]) / extent[d] if extent[d] > 0 else 0.0 for d in range(dimensions)]
            d = max(range(dimensions), key=lambda k: (width[k], -k))
            large.append(node)
            dims.append(d)
            stats.append({"bytes": r["bytes"], "lo": r[f"lo{d}"], "hi": r[f"hi{d}"],
                          "tie_lo": r["tie_lo"], "tie_hi": r["tie_hi"]})
        cuts = medians(points, tree, large, dims, stats) if large else []
        nodes = [new for node, cut in zip(large, cuts) if cut is not None for new in tree.split(node, cut)]
        tree.depth += bool(nodes)
    return tree


def assign_shards(docs: DataFrame, dimensions: list[str], target_bytes: float | None = None, shards: int | None = None,
                  text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 in a
    shard). Give the target bytes of a leaf, or the number of shards that the
    total is to be dealt to (a power of two)."""
    coords = {f"__d{i}": coordinate(docs, c) for i, c in enumerate(dimensions)}
    tie = tie_of(docs)
    size = row_bytes(F.col(f"`{text_col}`"))
    points = written(docs.select(*[c.alias(n) for n, c in coords.items()], tie.alias("__tie"), size.alias("__bytes")),
                     "points")
    whole = points.agg(F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    target = target_bytes if target_bytes is not None else whole["bytes"] / (shards or 1)
    tree = fit(points, len(dimensions), target)
    leaves = tree.leaves()
    place = {node: i for i, node in enumerate(leaves)}
    shard = F.element_at(constants([place.get(k, -1) for k in range(len(tree.cuts))], "int"), tree.node() + 1)
    slices = max(1, -(-whole["n"] // (SLICE_ROWS * len(leaves))))
    part = F.floor(F.col("__tie") * slices).cast("int")
    counts = points.groupBy(shard.alias("__shard"), part.alias("__part")).agg(F.count("*").alias("__n"))
    shift = counts.select("__shard", "__part", F.coalesce(F.sum("__n").over(
        Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__shift"))
    rows = docs.select("*", *[c.alias(n) for n, c in coords.items()], tie.alias("__tie"))
    rows = rows.select("*", shard.alias("__shard"), part.alias("__part")).drop(*coords)
    inside = F.row_number().over(Window.partitionBy("__shard", "__part").orderBy("__tie"))
    rows = rows.join(shift, ["__shard", "__part"]).withColumn("__slot", F.col("__shift") + inside - 1)
    return put(rows, size=size, shard=F.col("__shard"), slot=F.col("__slot").cast("long")).drop(
        "__shard", "__part", "__shift", "__slot", "__tie")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet folders ``shard=<n>``."""
    assign_shards(docs, **options).write.mode("errorifexists").partitionBy("shard").parquet(path)


def shard_files(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a fresh folder of the shared scratch space, read back."""
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    write_shards(docs, path, **options)
    files = spark.read
    schema = T.StructType([*[f for f in docs.schema if f.name.lower() not in ("size", "shard", "slot")],
                           T.StructField("size", T.LongType()), T.StructField("slot", T.LongType()),
                           T.StructField("shard", T.IntegerType())])
    return files.schema(schema).parquet(path)
