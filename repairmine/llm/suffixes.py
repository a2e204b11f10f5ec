"""Suffix-array dedup: common-prefix-aware distributed merge sort (operator 4).

Every byte is removed that a ``length``-byte string covers which also starts
anywhere else (same document included). Texts are UTF-8 bytes and matches do
not cross documents.

Sampling. A window is ``length`` bytes; its anchor is the position of the
smallest hashed gram (``layout``: 16 bytes) among its first ``span`` positions, so equal
windows have their anchors at the same place and an anchor owns a run of
windows (its block: the bytes those windows cover). All windows of an anchor
hold the ``length - span + 1`` bytes from the anchor on (its core), so only
anchors with equal cores can own equal windows.

1. Duplicate detection. Cores and blocks are fingerprinted (64 bits each).
   Core fingerprints are counted with map-side combining; a core found once
   settles its anchor: nothing repeats. Of the others, blocks are counted per
   (core, block): a block found twice repeats as a whole, and a core with one
   block only is settled by that.
2. Merge sort. What is left are cores with different blocks. One occurrence
   of each such block goes in as the suffix from its anchor, with the rest of
   the block kept beside it. Tasks sort their suffixes into runs, front-code
   them (length of the prefix shared with the one before, then the rest) and
   exchange them by core ranges. A loser tree merges the runs of a range: it
   keeps with every loser the prefix length it shares with the winner it lost
   to, decides by those lengths where they differ, and else compares only
   behind the known prefix. The merged order comes with the shared prefix
   lengths of neighbours, which cut it into groups of equal cores.
   A core with more than ``GROUP_BLOCKS`` blocks leaves the merge: its windows
   are fingerprinted and counted one by one.
3. Inside a group, blocks are aligned on their anchors. A window that starts
   ``o`` bytes before the anchor repeats if another block of the group has the
   same ``o`` bytes before and ``length - o`` bytes after it; the latter equals
   standing in one stretch of shared prefixes of at least that length.

The removed spans of a text depend on its bytes alone, so equal texts share
them; texts are addressed by a 64-bit hash and their length.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; null ids and extra columns pass through; equal rows are separate
occurrences (their texts go as a whole); an empty table gives no rows. In
``kept_text`` a character that loses some of its bytes goes as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget
from .common import buffer_of, key_groups, pieces, put, written

LENGTH = 400
#: Bytes of text that a task works on at once (a longer text by itself).
WORK = 1 << 18
#: Suffixes that one merging task gets on average, and the bound of the
#: sample that cuts the ranges.
RANGE_ROWS = 20_000
SAMPLE_ROWS = 20_000
#: Blocks that a group may have in one merging task; cores of more blocks (a
#: passage in very many different contexts) are settled window by window.
GROUP_BLOCKS = 50_000
#: Cells (blocks times offsets) that are compared at once.
CELLS = 1 << 21



def layout(length: int) -> tuple[int, int, int]:
    """(span, gram, core) for windows of ``length`` bytes: 256, 16 and 145 for 400."""
    span = max(1, length * 16 // 25)
    return span, max(1, min(16, length - span)), length - span + 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Fingerprints of substrings of one buffer, from prefix sums modulo 2**64.

    A byte stands for a seeded 64-bit number; the sum of number times power
    up to a position, differences of such sums, and the inverse power give a
    value that depends on the substring alone."""

    _table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def powers(cls, n: int):
        if len(cls._powers) < n:
            size = max(n, WORK + (1 << 16))
            back = np.uint64(pow(int(_ODD), -1, 1 << 64))
            for name, base in (("_powers", _ODD), ("_inverse", back)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls._powers, cls._inverse

    def __init__(self, raw: np.ndarray):
        power, self.inverse = self.powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self._table[raw] * power[:len(raw)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return _mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by blocks of ``w``."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Anchors of the texts in a buffer: text number, anchor, first and last
    owned window (positions in the buffer), core and block fingerprints."""
    span, gram, held = layout(length)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = Hasher(raw)
    g = h.grams(gram)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    own = (sliding_min(key, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    start = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    a = own[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])) if len(a) else none
    last = np.append(new[1:], len(a)) - 1
    text, at, lo, hi = text[new], a[new], start[new], start[last]
    core = h.of(at, at + held)
    block = _mix(h.of(lo, hi + length) ^ ((at - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
    return text, at, lo, hi, core, block


def front_code(items: list[bytes]) -> list[int]:
    """Length of the prefix that each sorted string shares with the one before."""
    return [0, *(shared(x, y, 0) for x, y in zip(items[:-1], items[1:]))][:len(items)]


def shared(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, ``known`` bytes of which are given."""
    low, high = known, min(len(x), len(y))
    if x[low:high] == y[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of (string, prefix shared with the run's previous
    string, payload). Yields (string, prefix shared with the previous winner,
    payload). Every waiting head carries the prefix length that it shares
    with the last winner, so a comparison never reads a known prefix again."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = 1
        while self.k < max(1, len(self.runs)):
            self.k *= 2
        self.loser: list = [None] * self.k

    def _next(self, r: int):
        x = next(self.runs[r], None) if r < len(self.runs) else None
        return None if x is None else [x[0], x[1], x[2], r]

    @staticmethod
    def _play(a, b):
        """(winner, loser) of two heads whose lengths refer to one string;
        the loser's length then refers to the winner."""
        if a is None:
            return b, a
        if b is None:
            return a, b
        if a[1] != b[1]:  # the longer shared prefix stays nearer to the last winner
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = a[0], b[0]
        n = shared(x, y, a[1])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        win, lose = (a, b) if first else (b, a)
        lose[1] = n
        return win, lose

    def __iter__(self):
        level = [self._next(r) for r in range(self.k)]
        for x in level:
            if x is not None:
                x[1] = 0
        at = self.k
        while at > 1:
            at //= 2
            won = []
            for i in range(at):
                w, lo = self._play(level[2 * i], level[2 * i + 1])
                self.loser[at + i] = lo
                won.append(w)
            level = won
        best = level[0]
        while best is not None:
            yield best[0], best[1], best[2]
            r = best[3]
            cur = self._next(r)
            i = (self.k + r) // 2
            while i:
                cur, self.loser[i] = self._play(cur, self.loser[i])
                i //= 2
            best = cur


def group_windows(items: list[tuple[bytes, int, bytes]], length: int) -> list[np.ndarray]:
    """For the blocks of one group in merged order, the offsets ``o`` before
    the anchor whose windows another block of the group has too. An item is
    (suffix from the anchor, prefix shared with the item before, bytes of the
    block before the anchor)."""
    n = len(items)
    right = np.array([len(x[0]) for x in items])
    common = np.array([x[1] for x in items])
    left = np.array([len(x[2]) for x in items])
    top = int(left.max())
    power = Hasher.powers(top + 1)[0]
    # column o: a fingerprint of the o bytes before the anchor
    mark = np.zeros((n, top + 1), dtype=np.uint64)
    for i, x in enumerate(items):
        if left[i]:
            mark[i, 1:left[i] + 1] = Hasher._table[np.frombuffer(x[2], np.uint8)[::-1]] * power[:left[i]]
    np.cumsum(mark, axis=1, out=mark)
    out = np.zeros((n, top + 1), dtype=bool)
    step = max(1, CELLS // n)
    for a in range(0, top + 1, step):
        o = np.arange(a, min(a + step, top + 1))
        # a stretch of neighbours that share length - o bytes has one number
        stretch = np.cumsum(common[:, None] < (length - o)[None, :], axis=0).astype(np.uint64)
        fit = (left[:, None] >= o[None, :]) & (right[:, None] >= (length - o)[None, :])
        key = _mix(mark[:, a:a + len(o)]) + _mix(stretch * np.uint64(1 << 20) + o.astype(np.uint64)[None, :] + np.uint64(1))
        _, where, seen = np.unique(key[fit], return_inverse=True, return_counts=True)
        found = np.zeros(fit.shape, dtype=bool)
        found[fit] = seen[where] > 1
        out[:, a:a + len(o)] = found
    return [np.flatnonzero(row) for row in out]


def _blocks(batches, length: int):
    """Rows (core, block, text hash, text length, anchor, before, after)."""
    forget()
    for batch in batches:
        for b in pieces(batch, "text", WORK):
            raw, off = buffer_of(b.column(b.schema.get_field_index("text")))
            text, at, lo, hi, core, block = anchors(raw, off, length)
            if not len(text):
                continue
            th = b.column(b.schema.get_field_index("th")).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), pa.array(th[text]),
                pa.array(np.diff(off)[text].astype(np.int32)), pa.array((at - off[text]).astype(np.int32)),
                pa.array((at - lo).astype(np.int16)), pa.array((at - hi).astype(np.int16))],
                names=["core", "block", "th", "tn", "at", "before", "after"])


_BLOCK = "core long, block long, th long, tn int, at int, before short, after short"


def addressed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``th`` and ``tn``, the hash and length of the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return docs.select("*", F.xxhash64(text).alias("__th"), F.octet_length(text).alias("__tn"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``th, tn, spans`` (array of start, stop) of every text that loses bytes."""
    base = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    texts = addressed(base, "text").where(F.col("__tn") >= length).select(
        "text", F.col("__th").alias("th"), F.col("__tn").alias("tn"))
    found = written(texts.select("text", "th").mapInArrow(lambda it: _blocks(it, length), _BLOCK), "blocks")
    # small tables are written before they are joined: AQE splits a hot key
    # only where both sides come straight from an exchange
    twice = written(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    some = written(found.join(twice, "core", "left_semi"), "repeated-cores")
    kinds = some.groupBy("core", "block").agg(
        F.count("*").alias("n"), F.first("th").alias("th"), F.first("tn").alias("tn"), F.first("at").alias("at"),
        F.first("before").alias("before"), F.first("after").alias("after"))
    kinds = written(kinds, "block-kinds")
    mixed = written(kinds.groupBy("core").agg(F.count("*").alias("k")).where("k > 1"), "mixed-cores")
    whole = some.join(kinds.where("n > 1").select("core", "block"), ["core", "block"], "left_semi").select(
        "th", "tn", (F.col("at") - F.col("before")).alias("start"), (F.col("at") - F.col("after") + length).alias("stop"))
    spans = whole.unionByName(merge_sorted(kinds.join(mixed.where(F.col("k") <= GROUP_BLOCKS), "core", "left_semi"),
                                           texts, length))
    crowded = mixed.where(F.col("k") > GROUP_BLOCKS)
    if not crowded.isEmpty():
        spans = spans.unionByName(by_window(kinds.join(crowded, "core", "left_semi"), texts, length))
    return written(spans.distinct().groupBy("th", "tn").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")


def wanted_blocks(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """``th, tn, text, own``: texts with their blocks (``at, before, after``
    and ``lone``: the block occurs once)."""
    wanted = written(blocks.groupBy("th", "tn").agg(F.collect_list(F.struct(
        "at", "before", "after", (F.col("n") == 1).alias("lone"))).alias("own")), "wanted")
    return texts.join(wanted, ["th", "tn"]).select("th", "tn", "text", "own")


def by_window(blocks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The windows of lone blocks that other blocks hold too, by fingerprint
    of every window: rows instead of groups, so no task holds a group."""

    def windows(batches):
        for batch in batches:
            for b in pieces(batch, "text", WORK):
                for x in b.to_pylist():
                    h = Hasher(np.frombuffer(x["text"], np.uint8))
                    start = np.concatenate([np.arange(o["at"] - o["before"], o["at"] - o["after"] + 1) for o in x["own"]])
                    lone = np.repeat([o["lone"] for o in x["own"]], [o["before"] - o["after"] + 1 for o in x["own"]])
                    m = len(start)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h.of(start, start + length).view(np.int64)), pa.array(np.full(m, x["th"], np.int64)),
                        pa.array(np.full(m, x["tn"], np.int32)), pa.array(start.astype(np.int32)), pa.array(lone)],
                        names=["window", "th", "tn", "start", "lone"])

    rows = written(wanted_blocks(blocks, texts).mapInArrow(
        windows, "window long, th long, tn int, start int, lone boolean").distinct(), "windows")
    again = written(rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    return rows.where("lone").join(again, "window", "left_semi").select(
        "th", "tn", "start", (F.col("start") + length).alias("stop"))


def merge_sorted(loose: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The distributed merge sort over blocks that share their core with
    others: ``th, tn, start, stop`` of the windows found to repeat in blocks
    that occur once."""
    core = layout(length)[2]

    def cut(batches):
        seen = set()  # equal texts stand in one task: one copy of them is cut
        for batch in batches:
            for b in pieces(batch, "text", WORK):
                out = []
                for x in b.select(["th", "tn", "text", "own"]).to_pylist():
                    if (x["th"], x["tn"]) in seen:
                        continue
                    seen.add((x["th"], x["tn"]))
                    t = x["text"]
                    for o in x["own"]:
                        at = o["at"]
                        out.append((t[at:at + length - o["after"]], t[at - o["before"]:at], x["th"], x["tn"], at,
                                    o["lone"]))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.bool_())],
                        names=["suffix", "left", "th", "tn", "at", "lone"])

    suffixes = written(wanted_blocks(loose, texts).mapInArrow(
        cut, "suffix binary, left binary, th long, tn int, at int, lone boolean"), "suffixes")
    n = suffixes.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    edges = []
    if ranges > 1:
        # a bounded sample cuts the ranges; they balance the work, nothing else
        sample = suffixes.sample(min(1.0, SAMPLE_ROWS / 2 / n), seed=7).select(
            F.substring("suffix", 1, core).alias("s")).limit(SAMPLE_ROWS).collect()
        s = sorted(bytes(r["s"]) for r in sample)
        edges = sorted({s[i * len(s) // ranges] for i in range(1, ranges)}) if s else []

    def runs(batches):
        """One sorted, front-coded run a batch and range."""
        from bisect import bisect_right
        task, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(6))), key=lambda r: r[:5])
            of = [bisect_right(edges, r[0][:core]) for r in rows]
            first = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or of[i] != of[first]:
                    part = rows[first:i]
                    same = front_code([r[0] for r in part])
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([of[first]] * m, pa.int32()), pa.array([(task << 32) | run] * m, pa.int64()),
                        pa.array(range(m), pa.int32()), pa.array(same, pa.int32()),
                        pa.array([r[0][k:] for r, k in zip(part, same)], pa.binary()),
                        *(pa.array([r[j] for r in part], t) for j, t in (
                            (1, pa.binary()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.bool_())))],
                        names=["range", "run", "place", "same", "rest", "left", "th", "tn", "at", "lone"])
                    first, run = i, run + 1

    coded = suffixes.mapInArrow(runs, "range int, run long, place int, same int, rest binary, left binary, th long, "
                                      "tn int, at int, lone boolean")

    def merged(batches):
        for t in key_groups(batches, "range"):
            yield from resolve(_runs_of(t), core, length)

    return (coded.repartition(max(ranges, 1), "range").sortWithinPartitions("range", "run", "place")
            .mapInArrow(merged, "th long, tn int, start int, stop int"))


def _runs_of(t: pa.Table) -> list:
    """The runs of one range as iterators of (suffix, shared prefix, payload);
    suffixes are decoded one at a time."""
    cols = [t.column(c).combine_chunks() for c in ("same", "rest", "left", "th", "tn", "at", "lone")]
    run = t.column("run").to_numpy()
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]

    def one(a: int, b: int):
        last = b""
        for i in range(a, b):
            same = cols[0][i].as_py()
            last = last[:same] + cols[1][i].as_py()
            yield last, same, tuple(c[i].as_py() for c in cols[2:])

    return [one(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def resolve(runs: list, core: int, length: int):
    """Merge the runs of a range and settle every group of equal cores."""
    group: list = []
    out: list = []

    def settle():
        # a block that copies of a text have sent more than once is one block
        kept, seen = [], set()
        for suffix, same, payload in group:
            if payload[1:4] not in seen:
                seen.add(payload[1:4])
                kept.append((suffix, same, payload))
        if len(kept) < 2 or not any(p[4] for _, _, p in kept):
            return
        for (_, _, p), offsets in zip(kept, group_windows([(s, c, p[0]) for s, c, p in kept], length)):
            if p[4] and len(offsets):
                # runs of neighbouring windows are one span
                for run in np.split(offsets, np.flatnonzero(np.diff(offsets) > 1) + 1):
                    out.append((p[1], p[2], p[3] - int(run[-1]), p[3] - int(run[0]) + length))

    def batch():
        cols = list(zip(*out))
        b = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])],
                                       names=["th", "tn", "start", "stop"])
        out.clear()
        return b

    for suffix, same, payload in LoserTree(runs):
        if group and same < core:
            settle()
            group = []
            if len(out) > 10_000:
                yield batch()
        group.append((suffix, same, payload))
    if group:
        settle()
    if out:
        yield batch()


def cut_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``removed`` (those runs: start, stop),
    ``kept_bytes`` and ``kept_text``. Runs of fewer than ``min_words`` words
    stay in the text."""
    spans = repeated_spans(docs, text_col, length).select(
        F.col("th").alias("__sh"), F.col("tn").alias("__sn"), F.col("spans").alias("__spans"))
    rows = addressed(docs, text_col)
    rows = rows.join(spans, (rows["__th"] == spans["__sh"]) & (rows["__tn"] == spans["__sn"]), "left")
    one = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))
    none = F.slice(F.array(one), 1, 0)
    last = lambda acc: F.element_at(acc, -1)
    # unite overlapping and touching spans, in order
    runs = F.aggregate(
        F.coalesce("__spans", none), none,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["stop"] >= x["start"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop"))))
        ).otherwise(F.concat(acc, F.array(x))))
    rows = rows.select("*", runs.alias("__found")).drop("__spans", "__sh", "__sn")

    # one function for both steps: two in a row would hold two workers a core
    @F.pandas_udf("removed array<struct<start:int,stop:int>>, kept_bytes binary, kept_text string")
    def keep(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for t, begin, end in zip(text, starts, stops):
            if t is None:
                out.append((None, None, None))
                continue
            own = [(a, b) for a, b in zip(begin, end) if not min_words or len(t[a:b].split()) >= min_words]
            kept = [t[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(t)])]
            # stretches of valid text: what does not decode is part of a character
            out.append(([{"start": a, "stop": b} for a, b in own], b"".join(kept),
                        "".join(k.decode("utf-8", "ignore") for k in kept)))
        return pd.DataFrame(out, columns=["removed", "kept_bytes", "kept_text"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cut = F.size("__found") > 0  # only texts with such runs go through Python
    rows = rows.select("*", keep.asNondeterministic()(
        F.when(cut, text.cast("binary")), F.when(cut, F.col("__found.start")), F.when(cut, F.col("__found.stop"))).alias("__k"))
    rows = rows.select("*", F.coalesce("__k.removed", none).alias("__runs"))
    lost = F.aggregate("__runs", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return put(rows, n_bytes=F.col("__tn").cast("long"), n_removed=lost, n_spans=F.size("__runs").cast("long"),
               removed=F.col("__runs"), kept_bytes=F.when(cut, F.col("__k.kept_bytes")).otherwise(text.cast("binary")),
               kept_text=F.when(cut, F.col("__k.kept_text")).otherwise(text)).drop("__tn", "__th", "__found", "__runs", "__k")
