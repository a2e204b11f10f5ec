"""Token-ID output: Re-Pair grammar compression (operator 2).

Documents are range-partitioned and sorted by id, encoded with a public
tokenizer, closed with an end id, and collected into blocks ("shards") of
about ``block_tokens`` ids. Per block, frequent id pairs are replaced by
nonterminals, most frequent bands first, until none reaches ``min_count``.
Pairs never cross a document's end, so every document is a run of symbols.

File format (Parquet, one row a block; all numbers little-endian): ``part``,
``block``, ``start_in_part`` (ids before it in its part), ``n_ids``,
``doc_ids``, ``doc_tokens``, ``doc_symbols`` (per document), ``base`` (first
nonterminal), ``rules`` (u4 pairs: left, right), ``rule_tokens`` (u4: ids a
rule expands to), ``symbols`` (u2 where base + rules fit, else u4).

Defined results: null text is an empty text (only the end id); null ids sort
first; rows equal in id are ordered by text (null first); an empty table
writes an empty file set; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repairmine.session import scratch_path

from .bpe import END_ID, encoder
from .common import pieces

BLOCK_TOKENS = 2_000_000
MIN_COUNT = 16
_SLOTS = 1 << 18


def compress(ids: np.ndarray, doc_tokens: np.ndarray, base: int, min_count: int = MIN_COUNT):
    """Re-Pair over one block: ``(symbols, doc_symbols, left, right)``.

    Each round replaces all pairs of the top frequency band (count at least
    ``n >> (10 + 2 * round)``, and ``min_count``) left to right without overlap,
    until no pair reaches ``min_count``.
    """
    seq = ids.astype(np.uint32)
    ends = np.cumsum(doc_tokens)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    n_rules, r, settled = 0, 0, None
    while len(seq) > 1:
        # codes are half as wide while all symbols are below 65,535
        narrow = base + n_rules < 1 << 16
        kind, half = (np.uint32, 16) if narrow else (np.uint64, 32)
        mixer, drop = (np.uint32(2654435761), 14) if narrow else (np.uint64(0x9E3779B97F4A7C15), 46)
        across = np.iinfo(kind).max  # stands for a pair across a document's end
        least = max(min_count, len(seq) >> min(10 + 2 * r, 62))
        r += 1
        cut = np.zeros(len(seq), dtype=bool)
        cut[ends[ends > 0] - 1] = True
        if settled is None:
            own = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
            own[cut[:-1]] = across
            # pairs share counting slots, so a slot's count bounds its pairs' counts
            slot = ((own * mixer) >> kind(drop)).astype(np.int64)
            pos = np.flatnonzero((np.bincount(slot, minlength=_SLOTS) >= least)[slot])
            own = own[pos]
        else:
            # the last round took all pairs of this band: only those with one
            # of its new symbols can reach it
            new = seq >= settled
            pos = np.flatnonzero((new[:-1] | new[1:]) & ~cut[:-1])
            own = (seq[pos].astype(kind) << kind(half)) | seq[pos + 1]
        pairs, counts = np.unique(own, return_counts=True)
        pairs = pairs[(counts >= least) & (pairs != across)]
        if not len(pairs):
            if least <= min_count:
                break
            continue
        which = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
        match = pairs[which] == own
        pos, which = pos[match], which[match]
        # of touching candidates keep every other one, from the left
        first = np.flatnonzero(np.diff(pos, prepend=-2) != 1)
        run = np.repeat(first, np.diff(first, append=len(pos)))
        take = ((np.arange(len(pos)) - run) & 1) == 0
        pos, which = pos[take], which[take]
        # pairs whose places all went to others get no rule
        used = np.bincount(which, minlength=len(pairs)) > 0
        number = np.cumsum(used) - 1
        pairs = pairs[used]
        settled = base + n_rules if least <= min_count else None
        left.append((pairs >> kind(half)).astype(np.int64))
        right.append((pairs & kind((1 << half) - 1)).astype(np.int64))
        seq[pos] = base + n_rules + number[which]
        n_rules += len(pairs)
        keep = np.ones(len(seq), dtype=bool)
        keep[pos + 1] = False
        ends = ends - np.searchsorted(pos + 1, ends, side="left")
        seq = seq[keep]
    none = np.zeros(0, np.int64)
    return (seq.astype(np.int64), np.diff(ends, prepend=0), np.concatenate(left) if left else none,
            np.concatenate(right) if right else none)


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to (a rule only refers to earlier ones)."""
    out = np.zeros(len(left), dtype=np.int64)
    done = np.zeros(len(left), dtype=bool)
    size = lambda s: np.where(s < base, 1, out[np.maximum(s - base, 0)])
    known = lambda s: (s < base) | done[np.maximum(s - base, 0)]
    while not done.all():
        now = ~done & known(left) & known(right)
        out[now] = size(left[now]) + size(right[now])
        done |= now
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids of a run of symbols, one level of rules a pass."""
    out = symbols.astype(np.int64)
    while len(out) and (rule := out >= base).any():
        width = 1 + rule.astype(np.int64)
        at = np.cumsum(width) - width
        wide = np.empty(int(width.sum()), dtype=np.int64)
        k = out[rule] - base
        wide[at[~rule]] = out[~rule]
        wide[at[rule]] = left[k]
        wide[at[rule] + 1] = right[k]
        out = wide
    return out


class Expander:
    """Expands many symbols of one block: the ids of all rules lie in one
    pool, of which every symbol is a slice."""

    def __init__(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int):
        rules = expand(base + np.arange(len(left)), left, right, base)
        self.pool = np.concatenate([np.arange(base), rules]).astype("<u4")
        self.length = np.concatenate([np.ones(base, np.int64), lengths])
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        end = np.cumsum(n)
        if not len(end):
            return self.pool[:0]
        return self.pool[np.repeat(self.start[symbols] - end + n, n) + np.arange(end[-1])]


def load_block(row: dict):
    """``(symbols, left, right, rule_tokens, base)`` of a block's row."""
    base = row["base"]
    rules = np.frombuffer(row["rules"], dtype="<u4").astype(np.int64).reshape(-1, 2)
    wide = base + len(rules) > 1 << 16
    symbols = np.frombuffer(row["symbols"], dtype="<u4" if wide else "<u2").astype(np.int64)
    return symbols, rules[:, 0], rules[:, 1], np.frombuffer(row["rule_tokens"], dtype="<u4").astype(np.int64), base


def decode_range(row: dict, document: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start:stop`` of one document of a block: expansion lengths find
    the symbols that cover the range, and only those are expanded."""
    symbols, left, right, lengths, base = load_block(row)
    a = sum(row["doc_symbols"][:document])
    own = symbols[a:a + row["doc_symbols"][document]]
    size = np.where(own < base, 1, lengths[np.maximum(own - base, 0)] if len(lengths) else 1)
    end = np.cumsum(size)
    i, j = np.searchsorted(end, start, side="right"), np.searchsorted(end, stop, side="left")
    skip = start - (end[i] - size[i] if i < len(own) else start)
    return expand(own[i:j + 1], left, right, base)[skip:skip + max(0, stop - start)]


def _block_row(part, block, start, docs, parts, base, id_type):
    ids = np.concatenate(parts)
    tokens = np.array([len(p) for p in parts], dtype=np.int64)
    symbols, doc_symbols, left, right = compress(ids, tokens, base)
    wide = base + len(left) > 1 << 16
    cols = [
        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
        pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(id_type)),
        pa.array([tokens], pa.list_(pa.int32())), pa.array([doc_symbols], pa.list_(pa.int32())),
        pa.array([base], pa.int32()),
        pa.array([np.stack([left, right], axis=1).astype("<u4").tobytes()], pa.binary()),
        pa.array([rule_lengths(left, right, base).astype("<u4").tobytes()], pa.binary()),
        pa.array([symbols.astype("<u4" if wide else "<u2").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


_NAMES = ["part", "block", "start_in_part", "n_ids", "doc_ids", "doc_tokens", "doc_symbols", "base", "rules",
          "rule_tokens", "symbols"]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``docs`` in ascending ``id_col`` order into files at ``path``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_tokens", T.ArrayType(T.IntegerType())),
        T.StructField("doc_symbols", T.ArrayType(T.IntegerType())), T.StructField("base", T.IntegerType()),
        T.StructField("rules", T.BinaryType()), T.StructField("rule_tokens", T.BinaryType()),
        T.StructField("symbols", T.BinaryType())])

    def blocks(batches):
        enc = encoder(tokenizer)
        base = enc.tok.get_vocab_size()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs, parts, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            for b in pieces(batch, "text", 4 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for d, raw in zip(b.column(0).to_pylist(), enc.encode(texts)):
                    ids = np.append(np.frombuffer(raw, dtype=enc.dtype), enc.dtype.type(END_ID))
                    docs.append(d)
                    parts.append(ids)
                    held += len(ids)
                    if held >= block_tokens:
                        yield _block_row(part, block, start, docs, parts, base, kind)
                        block, start, docs, parts, held = block + 1, start + held, [], [], 0
        if docs:
            yield _block_row(part, block, start, docs, parts, base, kind)

    (rows.repartitionByRange("id").sortWithinPartitions("id", "text")
     .mapInArrow(blocks, schema).write.mode("errorifexists").parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids`` (u4 bytes; null
    without ``with_ids``) ``, ids_crc32`` of every document; ``start`` counts the
    ids of all documents before it."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    from pyspark.sql import Window
    # one row a written part, so its broadcast is bounded by the writing tasks
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    located = files.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part"))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("ids_crc32", T.LongType())])

    def decode(batches):
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                symbols, left, right, lengths, base = load_block(row)
                ids = Expander(left, right, lengths, base)(symbols)
                cut = np.cumsum([0, *row["doc_tokens"]])
                raw = memoryview(ids.tobytes())
                # whole documents, about a million ids a batch
                first = 0
                while first < len(cut) - 1:
                    last = max(first + 1, int(np.searchsorted(cut, cut[first] + (1 << 20), side="right")) - 1)
                    own = [raw[4 * a:4 * b] for a, b in zip(cut[first:last].tolist(), cut[first + 1:last + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["doc_ids"][first:last], kind),
                        pa.array(row["start"] + cut[first:last], pa.int64()),
                        pa.array(np.diff(cut[first:last + 1]), pa.int64()),
                        pa.array(own, pa.binary()) if with_ids else pa.nulls(len(own), pa.binary()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
                    first = last

    return located.select("start", "doc_ids", "doc_tokens", "doc_symbols", "base", "rules", "rule_tokens",
                          "symbols").mapInArrow(decode, schema)


def token_files(docs: DataFrame, tokenizer: str, with_ids: bool = True, **options) -> DataFrame:
    """Write and read back in a fresh folder of the shared scratch space."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path, with_ids)
