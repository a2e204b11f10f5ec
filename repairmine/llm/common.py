"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairmine.session import materialize

#: Words are runs of anything but space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared checkpoint folder: computed once, and
    read again from files when an executor is lost."""
    return materialize(df.sparkSession, df, name)


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Add result columns; an input column of the same name (in any case) is
    replaced, never an error. Operators name the columns that they need in
    between with two leading underscores; such names are reserved."""
    new = {k.lower() for k in cols}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*keep, *[v.alias(k) for k, v in cols.items()])


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Slices of an Arrow batch with about ``max_bytes`` of text each (one
    row at least), so that working memory follows the bound and the longest
    text, not the batch."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def buffer_of(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(pc.cast(col, pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return raw[off[0]:off[-1]], off - off[0]


def key_groups(batches, key: str):
    """Arrow tables with the rows of one key each, from batches sorted by
    ``key``. A key may run over many batches; only its own rows are held."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
