"""Embedding near-dedup: NN-descent (operator 5).

Vectors are compared inside their label only. Equal vectors are one node with
a multiplicity. Every node keeps its ``NEIGHBOURS`` best neighbours:

1. Start: random-projection leaves. In each of ``TREES`` trees a node's leaf
   is its label and the signs of a few seeded projections (as many as bring
   a label's average leaf to ``LEAF`` nodes); larger leaves fall into chunks. A leaf's
   members are compared block-wise.
2. Refinement: each node brings its neighbours and its reverse neighbours
   together, and they are compared with each other. What beats the end of a
   list replaces it. This repeats until under ``DELTA`` of the entries change.
3. Saturation: a list whose last entry still reaches the threshold may hide
   links. Its bound doubles and the graph is refined again, until it ends
   below the threshold or holds ``LONGEST`` entries. Nodes that are still
   saturated then (members of large families) are taken in full from their
   whole label: in blocks, against all its nodes in blocks, keeping everything
   over the threshold (counts at both ends, and links to the smallest member
   of each connected group of a tile; not all pairs).
4. Audit: seeded nodes, which grow with the table and come first from those
   whose best neighbour is near or over the threshold, are searched in their
   whole label. More trees are planted and the graph is refined again if any
   of their links was lost, or, where they have none, if the nearest
   neighbour was found for less than ``RECALL`` of them. After ``ROUNDS`` such
   rounds every node is searched in its whole label.

Cosines are taken in double precision. Links below the threshold are never
kept. Defined results: a vector that is null, empty, zero or holds null or
non-finite components, and one with a null label, has no link and is its own
component; equal vectors link with each other; vectors of different lengths
never link; rows without an id have no link and a null component; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_groups, written
from .components import components

THRESHOLD = 0.98
NEIGHBOURS = 12
#: Entries up to which a saturated list grows.
LONGEST = 96
TREES = 6
LEAF = 64
CHUNK = 512
TILE = 4096
DELTA = 0.01
ROUNDS = 3
AUDIT = 512
AUDIT_SHARE = 1 / 64
NEAR = 0.05
RECALL = 0.9
_SEED = 99


def _matrix(col) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose rows have one
    length; scaled first, so that no square overflows or vanishes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, grp`` (length and label) ``, vec`` of every row; the last two
    are null where the vector links with nothing."""
    v = F.col(f"`{vector_col}`")
    fine = (F.col(f"`{label_col}`").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0))
    grp = F.concat_ws("/", F.size(v).cast("string"), F.col(f"`{label_col}`").cast("string"))
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(fine, grp).alias("grp"),
                          F.when(fine, F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("vec"))


def best(m: np.ndarray, ids: np.ndarray, k: int):
    """Per row the ``k`` best other rows: (node, neighbour, cosine)."""
    n = len(ids)
    out = []
    for a in range(0, n, CHUNK):
        c = m[a:a + CHUNK] @ m.T
        c[np.arange(len(c)), np.arange(a, a + len(c))] = -2
        kk = min(k, n - 1)
        top = np.argpartition(-c, kk - 1, axis=1)[:, :kk]
        out.append((np.repeat(ids[a:a + CHUNK], kk), ids[top].ravel(), np.take_along_axis(c, top, 1).ravel()))
    return [np.concatenate(x) for x in zip(*out)]


_EDGE = "node long, nbr long, cos double"


def _edges(parts) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["node", "nbr", "cos"])


def plant(nodes: DataFrame, sizes: DataFrame, trees: range, neighbours: int) -> DataFrame:
    """Edges found in the leaves of some random-projection trees."""
    kind = nodes.schema["vec"].dataType.simpleString()

    def leaves(batches):
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("grp", "bits", "node", "vec")}
            bits = col["bits"].to_numpy()
            length = np.diff(col["vec"].offsets.to_numpy())
            for t in trees:
                sign = np.zeros(b.num_rows, dtype=np.int64)
                for dim in np.unique(length).tolist():
                    rows = np.flatnonzero(length == dim)
                    planes = np.random.default_rng([_SEED, t, dim]).standard_normal((dim, 40))
                    on = (_matrix(col["vec"].take(pa.array(rows))) @ planes > 0) & (np.arange(40) < bits[rows][:, None])
                    sign[rows] = (on * (1 << np.arange(40, dtype=np.int64))).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, t, np.int32)), col["grp"], pa.array(sign), col["node"], col["vec"]],
                    names=["tree", "grp", "sign", "node", "vec"])

    signed = nodes.join(sizes, "grp").select("grp", "bits", "node", "vec").mapInArrow(
        leaves, f"tree int, grp string, sign long, node long, vec {kind}")
    signed = written(signed.select(F.xxhash64("tree", "grp", "sign").alias("leaf"), "node", "vec"), "leaves")
    # a leaf far above the average (a family of near copies) is dealt to
    # chunks; refinement and saturation bring the family together
    crowd = signed.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * CHUNK)).alias("chunks"))
    dealt = signed.join(crowd, "leaf").select(
        F.xxhash64("leaf", F.pmod(F.xxhash64("node", "leaf"), F.col("chunks"))).alias("leaf"), "node", "vec")

    def compare(batches):
        for t in key_groups(batches, "leaf"):
            if t.num_rows > 1:
                yield _edges([best(_matrix(t.column("vec")), t.column("node").to_numpy(), neighbours)])

    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare, _EDGE)


def trim(edges: DataFrame, bounds: DataFrame, neighbours: int) -> DataFrame:
    """The best of every node: ``node, nbrs`` (array of cos, nbr, best first)
    ``, bound`` (``neighbours``, or the node's own in ``bounds``). A node's
    candidates are bounded by its lists."""
    own = edges.groupBy("node", "nbr").agg(F.max("cos").alias("cos")).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("cos", "nbr")), asc=False).alias("nbrs"))
    own = own.join(bounds, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(neighbours)))
    return own.select("node", F.slice("nbrs", F.lit(1), F.col("bound")).alias("nbrs"), "bound")


def refine(graph: DataFrame, nodes: DataFrame, neighbours: int) -> DataFrame:
    """One round of neighbours of neighbours: edges that beat the end of a list."""
    out = graph.select("node", F.posexplode("nbrs").alias("place", "x")).select("node", "place", F.col("x.nbr").alias("nbr"))
    # the forward list and the best ``neighbours`` of the nodes that list it;
    # the others of a much listed node meet through their own lists
    back = out.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "place")
    back = back.groupBy("node", F.pmod(F.xxhash64("nbr"), F.lit(neighbours)).alias("seat")).agg(
        F.min(F.struct("place", "nbr")).alias("x")).select("node", F.col("x.nbr").alias("nbr"))
    member = out.select("node", "nbr").union(back).distinct()
    last = graph.select(F.col("node").alias("nbr"), F.when(F.size("nbrs") < F.col("bound"), F.lit(-1.0)).otherwise(
        F.element_at("nbrs", -1)["cos"]).alias("worst"))
    vec = nodes.select(F.col("node").alias("nbr"), "vec").join(last, "nbr")
    meeting = member.join(vec, "nbr")

    def compare(batches):
        parts, held = [], 0
        for t in key_groups(batches, "node"):
            ids, worst = t.column("nbr").to_numpy(), t.column("worst").to_numpy()
            m = _matrix(t.column("vec"))
            c = m @ m.T
            np.fill_diagonal(c, -2)
            a, b = np.nonzero(c > worst[:, None])
            if len(a):
                parts.append((ids[a], ids[b], c[a, b]))
                held += len(a)
            if held > 100_000:
                yield _edges(parts)
                parts, held = [], 0
        if parts:
            yield _edges(parts)

    return meeting.repartition("node").sortWithinPartitions("node").mapInArrow(compare, _EDGE)


def flat(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode("nbrs").alias("x")).select("node", F.col("x.nbr").alias("nbr"),
                                                                    F.col("x.cos").alias("cos"))


def descend(edges: DataFrame, bounds: DataFrame, nodes: DataFrame, neighbours: int) -> DataFrame:
    """Refine until the lists hardly change."""
    graph = written(trim(edges, bounds, neighbours), "graph")
    for _ in range(8):
        new = written(trim(flat(graph).union(refine(graph, nodes, neighbours)), bounds, neighbours), "graph")
        moved = flat(new).join(flat(graph), ["node", "nbr"], "left_anti").count()
        graph = new
        if moved <= DELTA * max(1, graph.count()) * neighbours:
            break
    return graph


def enlarge(graph: DataFrame, nodes: DataFrame, neighbours: int, threshold: float, longest: int = LONGEST) -> DataFrame:
    """Double the bounds of saturated lists and refine, until none that may
    still grow is saturated."""
    while True:
        grow = written(saturated(graph, threshold).join(graph, "node").where(F.col("bound") < longest).select("node"), "grow")
        if grow.isEmpty():
            return graph
        wider = F.when(F.col("more"), F.least(F.lit(longest), F.col("bound") * 2)).otherwise(F.col("bound"))
        bounds = written(graph.join(grow.withColumn("more", F.lit(True)), "node", "left").select(
            "node", wider.alias("bound")).where(F.col("bound") > neighbours), "bounds")
        graph = descend(flat(graph), bounds, nodes, neighbours)


_TILE = "node long, ask boolean, links long, pairs long, nbr long, best double"


def connected(hit: np.ndarray):
    """Group numbers of the rows and columns of a tile (-1: no hit). Every row
    and column is looked up once."""
    row, col = np.full(hit.shape[0], -1), np.full(hit.shape[1], -1)
    for s in np.flatnonzero(hit.any(axis=1)).tolist():
        new = np.array([s]) if row[s] < 0 else row[:0]
        while len(new):
            row[new] = s
            met = np.flatnonzero(hit[new].any(axis=0) & (col < 0))
            col[met] = s
            new = np.flatnonzero(hit[:, met].any(axis=1) & (row < 0))
    return row, col


def in_full(asked: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """All links of the ``asked`` nodes, from their whole labels. Rows a node
    and block: ``links`` (weighted by copies) and ``pairs`` counted in the
    block, and ``nbr``, the smallest member that the block connects it with.
    Asked nodes (``ask``) also have ``best``, the largest cosine in the block;
    the counts of the others are those with asked nodes only."""
    own = nodes.join(asked, "node", "left_semi")
    # blocks grow with the label up to ``TILE``, so that rows are not repeated
    # with its size
    side = F.least(F.lit(TILE), F.greatest(F.lit(CHUNK), F.sqrt("n") * 16))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n")).join(
        own.groupBy("grp").agg(F.count("*").alias("n_asked")), "grp").select(
        "grp", F.ceil(F.col("n") / side).alias("n_col"), F.ceil(F.col("n_asked") / side).alias("n_row"))
    seat, every = lambda n: F.pmod(F.xxhash64("node"), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = own.join(sizes, "grp").select("*", seat("n_row").alias("row"), every("n_col").alias("col"), F.lit(True).alias("ask"))
    met = nodes.join(sizes, "grp").select("*", seat("n_col").alias("col"), every("n_row").alias("row"), F.lit(False).alias("ask"))
    tiles = own.unionByName(met, allowMissingColumns=True).select(
        F.xxhash64("grp", "row", "col").alias("tile"), "ask", "node", "vec", "copies")

    def compare(batches):
        for t in key_groups(batches, "tile"):
            ask = np.array(t.column("ask").to_pylist())
            if ask.all() or not ask.any():
                continue
            m, ids, copies = _matrix(t.column("vec")), t.column("node").to_numpy(), t.column("copies").to_numpy()
            p, q, a, b = m[ask], m[~ask], ids[ask], ids[~ask]
            hit, best = [], []
            for i in range(0, len(a), CHUNK):
                c = p[i:i + CHUNK] @ q.T
                c[a[i:i + CHUNK, None] == b] = -2
                hit.append(c >= threshold)
                best.append(c.max(axis=1))
            hit, best = np.concatenate(hit), np.concatenate(best)
            row, col = connected(hit)
            least = np.full(len(a), np.iinfo(np.int64).max)
            np.minimum.at(least, row[row >= 0], a[row >= 0])
            np.minimum.at(least, col[col >= 0], b[col >= 0])
            met = col >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
                (a, b[met]), (np.ones(len(a), bool), np.zeros(met.sum(), bool)),
                (hit @ copies[~ask], copies[ask] @ hit[:, met]), (hit.sum(axis=1), hit[:, met].sum(axis=0)),
                (np.where(row >= 0, least[row], a), least[col[met]]), (best, np.full(met.sum(), -2.0)))],
                names=["node", "ask", "links", "pairs", "nbr", "best"])

    return written(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, _TILE), "tiles")


def saturated(graph: DataFrame, threshold: float) -> DataFrame:
    """Nodes whose lists may hide links."""
    return graph.where((F.size("nbrs") >= F.col("bound")) & (F.element_at("nbrs", -1)["cos"] >= threshold)).select("node")


def count_links(tiles: DataFrame, full: DataFrame, links: DataFrame, weight: DataFrame) -> DataFrame:
    """``node, links`` (weighted by copies) ``, pairs``, one row a node: the
    ``full`` nodes as their tiles count them; the others by their listed links
    among themselves and the hits that tiles report with full ones."""
    own = tiles.where("ask").select("node", "links", "pairs")
    met = tiles.where("not ask").join(full, "node", "left_anti").select("node", "links", "pairs")
    among = links.join(full, "node", "left_anti").join(full.withColumnRenamed("node", "nbr"), "nbr", "left_anti").join(
        weight, "nbr").select("node", F.col("weight").alias("links"), F.lit(1).cast("long").alias("pairs"))
    return own.union(met).union(among).groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))


def picked(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Seeded nodes for the audit: of those with a neighbour near or over the
    threshold, and of the others, ``AUDIT`` or ``AUDIT_SHARE`` of them."""
    near = graph.where(F.element_at("nbrs", 1)["cos"] >= threshold - NEAR).select("node", F.lit(True).alias("near"))
    kind = nodes.select("node").join(near, "node", "left").select("node", F.coalesce("near", F.lit(False)).alias("near"))
    n = {r["near"]: r["count"] for r in kind.groupBy("near").count().collect()}
    share = {k: max(AUDIT_SHARE, AUDIT / n.get(k, 1)) for k in (True, False)}
    draw = F.pmod(F.xxhash64("node", F.lit(_SEED)), F.lit(1 << 20)) / (1 << 20)
    return written(kind.where(draw < F.when(F.col("near"), share[True]).otherwise(share[False])).select("node"), "picked")


def audit(degrees: DataFrame, graph: DataFrame, asked: DataFrame, nodes: DataFrame, threshold: float):
    """Over the ``asked`` nodes: (share of their true links that ``degrees``
    holds, or None if they have none; share of them whose true nearest
    neighbour stands first in the graph)."""
    true = in_full(asked, nodes, threshold).where("ask").groupBy("node").agg(
        F.sum("pairs").alias("true"), F.max("best").alias("best"))
    first = graph.select("node", F.element_at("nbrs", 1)["cos"].alias("first"))
    r = asked.join(true, "node").join(degrees, "node", "left").join(first, "node", "left").agg(
        F.sum("true").alias("true"), F.sum(F.coalesce("pairs", F.lit(0))).alias("got"), F.avg(F.when(
            (F.col("best") <= -2) | (F.col("first") >= F.col("best") - 1e-9), 1.0).otherwise(0.0)).alias("near")).first()
    return r["got"] / r["true"] if r["true"] else None, 1.0 if r["near"] is None else r["near"]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = keyed(vectors, id_col, vector_col, label_col)
    nodes = written(rows.where(F.col("vec_id").isNotNull() & F.col("grp").isNotNull()).groupBy("grp", "vec").agg(
        F.min("vec_id").cast("long").alias("node"), F.count("*").alias("copies")), "nodes")
    sizes = nodes.groupBy("grp").agg(F.greatest(
        F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.count("*") / LEAF)))).cast("int").alias("bits"))
    weight = nodes.select(F.col("node").alias("nbr"), F.col("copies").alias("weight"))
    none = nodes.where("false").select("node", F.lit(0).alias("bound"))
    graph = None
    for i in range(ROUNDS):
        edges = plant(nodes, sizes, range(i * TREES, (i + 1) * TREES), neighbours)
        graph = descend(edges if graph is None else flat(graph).union(edges), none, nodes, neighbours)
        graph = enlarge(graph, nodes, neighbours, threshold)
        # a link counts at both ends, whichever list it stands in
        listed = flat(graph).where(F.col("cos") >= threshold)
        links = written(listed.select("node", "nbr").union(listed.select("nbr", "node")).distinct(), "links")
        full = written(saturated(graph, threshold), "saturated")
        tiles = in_full(full, nodes, threshold)
        degrees = written(count_links(tiles, full, links, weight), "degrees")
        kept, near = audit(degrees, graph, picked(graph, nodes, threshold), nodes, threshold)
        if kept == 1 or (kept is None and near >= RECALL):
            break
    else:
        tiles = in_full(nodes.select("node"), nodes, threshold)
        degrees = tiles.where("ask").groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))
    of = components(links.select(F.col("node").alias("a"), F.col("nbr").alias("b")).union(tiles.select("node", "nbr").where("node <> nbr")))
    told = nodes.join(degrees, "node", "left").join(of, "node", "left").select(
        "grp", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("_component"))
    component = F.coalesce("_component", "vec_id")
    return rows.join(told, ["grp", "vec"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
