"""Ranked lexical search: Block-Max MaxScore (operator 12).

Index. Every task cuts its documents into shards of about ``SHARD_BYTES`` of
text and writes one row a shard: document ids and lengths, a term dictionary,
and a posting list for every term. Lists are cut into blocks of ``BLOCK``
postings, stored as gaps and counts in as few bytes as the block needs. A
block keeps its impacts (pairs of count and length that no other posting of
the block beats in both), so its exact maximum is known for any corpus
statistics without its postings.

Search. Document frequencies come from the dictionaries alone. Then every
shard is searched for the queries of a block of queries:

1. The lists of a query are ordered by their bounds (weight times best
   impact). As many of the smallest as together stay below the score of the
   query's last hit are non-essential: no document scores by them alone.
2. The other, essential lists are decoded and give the candidates.
3. The non-essential lists follow by falling bound. A candidate goes as soon
   as its score, the maximum of the one block that may hold it and the bounds
   of what is left stay below the last hit; only blocks that still have a
   candidate are decoded.

A task keeps one heap a query over all its shards, so later shards start with
a high bar. The heaps of the tasks are merged in two steps (lanes of tasks,
then all). A document is never dropped while its bound equals the bar: equal
scores are decided by the smaller id.

Defined results: null text has no term; a document without an id counts in
the statistics and comes last among equal scores; repeated rows are documents
of their own; queries with one id are one query with all their terms; queries
without a term, or without a hit above 0, give no rows; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import forget
from .common import written

BLOCK = 128
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 16
#: Bytes of one text that are split at once.
CHUNK = 1 << 20
#: Queries that one pass over the index serves.
QUERIES = 500
TOP = 50
LANES = 64

#: Term characters: digits, letters A-Z (lower-cased) and everything beyond
#: ASCII; every other byte separates.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_terms(text: str | bytes | None):
    """Lists of terms (bytes) of a text, chunk by chunk."""
    if text is None:
        return
    raw = (text.encode() if isinstance(text, str) else text).translate(_TABLE)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + CHUNK) if len(raw) - start > CHUNK else -1
        yield raw[start:end if end >= 0 else None].split()
        start = end if end >= 0 else len(raw)


def impact(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """A term's share of the score, before its weight."""
    m = 50 + (50 * n.astype(np.int64) * total_docs) // total_terms
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _width(x: np.ndarray) -> np.ndarray:
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4)).astype(np.int64)


def _put(out: np.ndarray, at: np.ndarray, width: np.ndarray, value: np.ndarray) -> None:
    """Little-endian values of 1, 2 or 4 bytes at byte positions."""
    for k in range(4):
        if k:
            on = width > k
            at, width, value = at[on], width[on], value[on]
        out[at + k] = (value >> (8 * k)) & 255


def build_shard(docs: list) -> dict | None:
    """The index of some (id, text) rows; None if they hold no term."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    vocab: dict[bytes, int] = {}
    add, ids, lens, parts = vocab.setdefault, [], [], []
    for i, text in docs:
        own = [np.array([add(t, len(vocab)) for t in terms], dtype=np.int64) for terms in split_terms(text)]
        n = sum(map(len, own))
        if n:
            parts.append(np.concatenate(own) if len(own) > 1 else own[0])
            lens.append(n)
            ids.append(i)
    if not ids:
        return None
    lens_ = np.array(lens, dtype=np.int64)
    # postings by (term, document); a key's repeats are its count
    key, tf = np.unique(np.concatenate(parts) * len(ids) + np.repeat(np.arange(len(ids)), lens_), return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    df = np.bincount(term, minlength=len(vocab))
    first = np.cumsum(df) - df
    rank = np.arange(len(key)) - first[term]
    blocks = -(-df // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    block = block_at[term] + rank // BLOCK
    start = np.flatnonzero(np.diff(block, prepend=-1))
    count = np.diff(np.append(start, len(key)))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    wide_gap, wide_tf = (_width(np.maximum.reduceat(x, start)) for x in (gap, tf))
    place = np.cumsum(count * (wide_gap + wide_tf)) - count * (wide_gap + wide_tf)
    data = np.zeros(int((count * (wide_gap + wide_tf)).sum()), dtype=np.uint8)
    inside = np.arange(len(key)) - start[block]
    _put(data, place[block] + inside * wide_gap[block], wide_gap[block], gap)
    _put(data, (place + count * wide_gap)[block] + inside * wide_tf[block], wide_tf[block], tf)
    # impacts: by falling count, those shorter than all before them
    n = lens_[doc]
    order = np.lexsort((n, -tf, block))
    floor = np.minimum.accumulate(n[order] - block[order] * (int(lens_.max()) + 1))
    new = np.concatenate([[True], floor[1:] < floor[:-1]])
    imp = order[new]
    imp_at = np.searchsorted(block[imp], np.arange(len(start) + 1))
    words = list(vocab)
    return {
        "docs": len(ids), "terms": int(lens_.sum()),
        "ids": np.array([-1 if i is None else i for i in ids], np.int64).tobytes(),
        "known": np.array([i is not None for i in ids]).tobytes(), "lens": lens_.astype(np.int32).tobytes(),
        "words": b"".join(words), "word_at": np.cumsum([0, *map(len, words)]).astype(np.int32).tobytes(),
        "df": df.astype(np.int32).tobytes(), "block_at": block_at.astype(np.int32).tobytes(),
        "last": doc[start + count - 1].astype(np.int32).tobytes(), "count": count.astype(np.uint8).tobytes(),
        "place": place.tobytes(), "widths": (wide_gap * 8 + wide_tf).astype(np.uint8).tobytes(), "data": data.tobytes(),
        "imp_at": imp_at.astype(np.int32).tobytes(), "imp_tf": tf[imp].astype(np.int32).tobytes(),
        "imp_n": n[imp].astype(np.int32).tobytes()}


_INDEX = ("docs long, terms long, ids binary, known binary, lens binary, words binary, word_at binary, df binary, "
          "block_at binary, last binary, count binary, place binary, widths binary, data binary, imp_at binary, "
          "imp_tf binary, imp_n binary")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of all rows, one row a shard. Documents stay in the
    tasks that scan them."""

    def shards(batches):
        forget()
        held, size = [], 0

        def row():
            out = build_shard(held)
            held.clear()
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out.values()], names=list(out))

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                t = t.as_py()
                if t:
                    held.append((i.as_py(), t))
                    size += len(t)
                    if size > shard_bytes or len(held) >= SHARD_DOCS:
                        yield from row()
                        size = 0
        yield from row()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return written(rows.mapInArrow(shards, _INDEX), "index")


def _words(words, word_at) -> pa.Array:
    """The dictionary of a shard, without a copy."""
    at = np.frombuffer(word_at, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(words)])


def frequencies(index: DataFrame, terms: list[bytes]) -> DataFrame:
    """``term`` (number in ``terms``) ``, df`` over all shards."""

    def found(batches):
        asked = pa.array(terms, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for words, at, df in zip(*(b.column(i).to_pylist() for i in range(3))):
                where = pc.index_in(asked, value_set=_words(words, at)).fill_null(-1).to_numpy()
                on = where >= 0
                total[on] += np.frombuffer(df, np.int32)[where[on]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return index.select("words", "word_at", "df").mapInArrow(found, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df"))


class Shard:
    """A shard's index row, opened for some terms: ``where`` is the place of
    each in the dictionary (-1: not there)."""

    def __init__(self, row: dict, asked: pa.Array, total_docs: int, total_terms: int):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.where = pc.index_in(asked, value_set=_words(row["words"], row["word_at"])).fill_null(-1).to_numpy()
        self.block_at, self.last = get("block_at", np.int32), get("last", np.int32)
        self.count, self.place, self.widths = get("count", np.uint8), get("place", np.int64), get("widths", np.uint8)
        self.imp_at, self.imp_tf, self.imp_n = get("imp_at", np.int32), get("imp_tf", np.int32), get("imp_n", np.int32)
        self.data, self.ids, self.known = row["data"], get("ids", np.int64), get("known", bool)
        self.lens, self.total = get("lens", np.int32), (total_docs, total_terms)
        self.maxima: dict[int, np.ndarray] = {}
        self.decoded: dict[int, tuple] = {}

    def block_maxima(self, t: int) -> np.ndarray:
        """The best impact of every block of a list."""
        if t not in self.maxima:
            a, b = self.block_at[t], self.block_at[t + 1]
            lo, hi = self.imp_at[a], self.imp_at[b]
            best = impact(self.imp_tf[lo:hi], self.imp_n[lo:hi], *self.total)
            self.maxima[t] = np.maximum.reduceat(best, self.imp_at[a:b] - lo)
        return self.maxima[t]

    def block(self, t: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of one block, decoded when first asked for."""
        if b not in self.decoded:
            n, at, w = int(self.count[b]), int(self.place[b]), int(self.widths[b])
            gaps = np.frombuffer(self.data, f"<u{w >> 3}", n, at)
            tf = np.frombuffer(self.data, f"<u{w & 7}", n, at + n * (w >> 3))
            before = int(self.last[b - 1]) if b > self.block_at[t] else -1
            docs = before + np.cumsum(gaps, dtype=np.int64)
            self.decoded[b] = docs, impact(tf, self.lens[docs], *self.total)
        return self.decoded[b]


def search_shard(s: Shard, terms: np.ndarray, weights: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard (numbers) and scores, of at least ``bar`` and
    over 0, for one query: its terms by their numbers, and their weights."""
    lists = s.where[terms]
    on = (lists >= 0) & (weights > 0)
    lists, weights = lists[on], weights[on]
    bound = np.array([int(s.block_maxima(t).max()) * int(w) for t, w in zip(lists, weights)], dtype=np.int64)
    order = np.argsort(bound, kind="stable")
    lists, weights, bound = lists[order], weights[order], bound[order]
    upto = np.cumsum(bound)
    split = int(np.searchsorted(upto, bar, side="left"))  # lists before it stay below the bar together
    score = np.zeros(len(s.ids), np.int64)
    for t, w in zip(lists[split:].tolist(), weights[split:].tolist()):
        for b in range(s.block_at[t], s.block_at[t + 1]):
            docs, imp = s.block(t, b)
            score[docs] += w * imp
    cand = np.flatnonzero(score)
    for j in range(split - 1, -1, -1):
        t, w = int(lists[j]), int(weights[j])
        cand = cand[score[cand] + upto[j] >= bar]
        if not len(cand):
            break
        a, e = int(s.block_at[t]), int(s.block_at[t + 1])
        at = np.searchsorted(s.last[a:e], cand)  # the one block that may hold it
        top = np.append(s.block_maxima(t), 0)[at] * w
        keep = score[cand] + top + (upto[j - 1] if j else 0) >= bar
        cand, at = cand[keep], at[keep]
        for b in np.unique(at[at < e - a]).tolist():
            docs, imp = s.block(t, a + b)
            mine = cand[at == b]
            k = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
            score[mine] += np.where(docs[k] == mine, w * imp[k], 0)
    cand = cand[(score[cand] >= bar) & (score[cand] > 0)]
    return cand, score[cand]


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of every query's best documents."""

    def terms_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted({t for part in split_terms(x) for t in part})
                                        for x in b.column(1).to_pylist()], pa.list_(pa.binary()))], names=["item_id", "terms"])

    item = F.col(f"`{id_col}`")
    kind = queries.schema[id_col].dataType
    name = kind.simpleString()
    asked = queries.select(item.alias("item_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(
        terms_of, f"item_id {name}, terms array<binary>")
    asked = asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = written(asked.where(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "queries")
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    hits = None
    for k in range(blocks):
        rows = asked.where(F.col("block") == k).select("item_id", "terms").collect()  # about QUERIES of them
        part = _hits(index, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows], kind, top, total["docs"], total["terms"])
        hits = part if hits is None else hits.union(part)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lane = Window.partitionBy("item_id", F.pmod("task", F.lit(LANES))).orderBy(*best)
    lanes = hits.withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return lanes.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def _hits(index: DataFrame, queries: list, kind, top: int, total_docs: int, total_terms: int) -> DataFrame:
    """The heaps of all tasks for one block of queries."""
    terms = sorted({t for _, ts in queries for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    weight = np.zeros(len(terms), np.int64)  # a term that no document holds has no list either
    share = (F.lit(2 * total_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")
    for r in frequencies(index, terms).select("term", F.floor(F.lit(1000.0) * F.log(share)).alias("w")).collect():
        weight[r["term"]] = r["w"]
    wanted = [(i, np.array([number[t] for t in ts])) for i, ts in queries]
    arrow = to_arrow_type(kind)

    def run(batches):
        asked = pa.array(terms, pa.binary())
        # a query's heap: score, id, id known (best first)
        none = np.zeros(0, np.int64)
        heaps = [(none, none, none.astype(bool))] * len(wanted)
        for b in batches:
            for i in range(b.num_rows):
                s = Shard({c: b.column(c)[i].as_py() for c in b.schema.names}, asked, total_docs, total_terms)
                for q, (_, ts) in enumerate(wanted):
                    heap = heaps[q]
                    cand, score = search_shard(s, ts, weight[ts], int(heap[0][-1]) if len(heap[0]) >= top else 0)
                    if len(cand):
                        every = [np.concatenate(x) for x in zip(heap, (score, s.ids[cand], s.known[cand]))]
                        order = np.lexsort((every[1], ~every[2], -every[0]))[:top]
                        heaps[q] = tuple(x[order] for x in every)
        task = TaskContext.get().partitionId()
        for (item, _), (score, ids, known) in zip(wanted, heaps):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(score), arrow), pa.array([task] * len(score), pa.int32()), pa.array(ids, mask=~known),
                     pa.array(score)], names=["item_id", "task", "doc_id", "score"])

    return index.drop("docs", "terms", "df").mapInArrow(run, f"item_id {kind.simpleString()}, task int, doc_id long, score long")
