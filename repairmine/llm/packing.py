"""Packing: cost-balanced packing (operator 10).

Every document is encoded, closed with the end id and cut into pieces of
``capacity`` ids and a rest. A rest costs ``length + length**2 / capacity``
(linear work plus attention inside the piece). Rests are packed in windows
of ``window`` documents: in descending order each goes to the sequence with
the lowest cost so far that has room for it; one that fits nowhere is cut
over the roomiest sequences. A window opens only as many sequences as its
ids need, so it pads less than one sequence.

Windows live inside the input partitions, so nothing is shuffled; a retried
task packs the same rows the same way. Defined results: null text is empty
(a piece of one end id); repeated rows are documents of their own; null ids
stay null; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import END_ID, encoder
from .common import pieces

CAPACITY = 1024
WINDOW = 4096


def balance(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, start in the item, length)`` for items shorter
    than ``capacity``."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        start, rest = 0, int(lengths[i])
        while rest:
            k = int(np.argmin(np.where(room >= rest, cost, np.inf)))
            if room[k] < rest:
                k = int(np.argmax(room))
            take = min(rest, int(room[k]))
            out[k].append((i, start, take))
            room[k] -= take
            cost[k] += take + take * take / capacity
            start, rest = start + take, rest - take
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row a sequence: ``sequence_id, n_tokens, padded_length, tokens``
    (little-endian u4 ids) and ``pieces``, an array of ``doc_id, start,
    length, doc_tokens, offset``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    piece = T.StructType([T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("start", T.LongType()),
                          T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                          T.StructField("offset", T.LongType())])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("padded_length", T.LongType()), T.StructField("tokens", T.BinaryType()),
                           T.StructField("pieces", T.ArrayType(piece))])

    def pack(batches):
        enc = encoder(tokenizer)
        first_id, n_seq = TaskContext.get().partitionId() << 40, 0
        kind = None
        ready: list[tuple[bytes, list]] = []
        rests: list[tuple] = []  # (doc id, start, ids, tokens of the document)

        def packed():
            lengths = np.array([len(r[2]) for r in rests], dtype=np.int64)
            for seq in balance(lengths, capacity):
                parts, place, ids = [], 0, []
                for i, start, n in seq:
                    d, at, own, tokens = rests[i]
                    parts.append((d, at + start, n, tokens, place))
                    ids.append(own[start:start + n])
                    place += n
                ready.append((np.concatenate(ids).astype("<u4").tobytes(), parts))
            rests.clear()

        def out():
            nonlocal n_seq
            ids = pa.array(range(first_id + n_seq, first_id + n_seq + len(ready)), pa.int64())
            n_seq += len(ready)
            n = [len(t) // 4 for t, _ in ready]
            fields = [(kind, 0), (pa.int64(), 1), (pa.int64(), 2), (pa.int64(), 3), (pa.int64(), 4)]
            flat = [x for _, p in ready for x in p]
            inner = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for t, k in fields],
                                               names=["doc_id", "start", "length", "doc_tokens", "offset"])
            offsets = pa.array(np.cumsum([0, *(len(p) for _, p in ready)]), pa.int32())
            batch = pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()),
                 pa.array([x if x & (x - 1) == 0 else capacity for x in n], pa.int64()),
                 pa.array([t for t, _ in ready], pa.binary()), pa.ListArray.from_arrays(offsets, inner)],
                names=["sequence_id", "n_tokens", "padded_length", "tokens", "pieces"])
            ready.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("id").type
            for b in pieces(batch, "text", 4 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for d, raw in zip(b.column(0).to_pylist(), enc.encode(texts)):
                    ids = np.append(np.frombuffer(raw, dtype=enc.dtype), enc.dtype.type(END_ID))
                    full = len(ids) - len(ids) % capacity
                    for at in range(0, full, capacity):
                        ready.append((ids[at:at + capacity].astype("<u4").tobytes(), [(d, at, capacity, len(ids), 0)]))
                    if full < len(ids):
                        rests.append((d, full, ids[full:], len(ids)))
                        if len(rests) == window:
                            packed()
                    if len(ready) >= 2048:
                        yield out()
        if rests:
            packed()
        if ready:
            yield out()

    return rows.mapInArrow(pack, schema)


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """One row a piece, with its ``ids`` cut out of its sequence's tokens."""
    p = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    ids = F.expr("substring(tokens, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))")
    return p.select("p.doc_id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "p.doc_tokens", "sequence_id",
                    "p.offset", ids.alias("ids"))
