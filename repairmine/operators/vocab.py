"""Vocabularies, encodings and padding.

Dense ids in a global order never go through one task: rows are range
partitioned on the order columns and written once with their partition
number, so numbers inside a partition and the partitions' offsets come from
the same files whatever columns a query reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from repairmine.session import materialize

# Position and unknown labels, and the n-gram edge labels.
BEGIN, END, UNK = "<BEGIN>", "<END>", "<UNK>"
NGRAM_BEGIN, NGRAM_END = "<BEGIN>", "<END>"


def dense_ids(df: DataFrame, order: list[Column], id_col: str = "id") -> DataFrame:
    """0-based ids in the given total order (ties must not exist).

    The number of ranges is the session's shuffle width, coalesced by size at
    run time; the offsets table has one row a range."""
    r = materialize(df.sparkSession, df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    sizes = r.groupBy("_pid").agg(F.count("*").alias("_c"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    r = r.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    return (r.join(F.broadcast(offs), "_pid")  # bounded by the number of ranges
            .withColumn(id_col, F.col("_off") + F.col("_rn") - 1).drop("_pid", "_rn", "_off"))


def word_vocab(tokens: DataFrame, tok_col: str = "tok", min_count: int = 1,
               specials=(BEGIN, END, UNK)) -> DataFrame:
    """V1: ``tok, cnt, id``; words by (count desc, word), then the special
    labels appended in sorted order (one ordering, one id pass)."""
    counts = (tokens.groupBy(tok_col).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
              .withColumn("_sp", F.lit(0)))
    spec = tokens.sparkSession.createDataFrame([(s, 0, 1) for s in specials], f"{tok_col} string, cnt long, _sp int")
    allw = counts.unionByName(spec)
    return dense_ids(allw, [F.col("_sp"), F.col("cnt").desc(), F.col(tok_col)]).select(tok_col, "cnt", "id")


def encode_tokens(docs: DataFrame, doc_col: str, toks_col: str, vocab: DataFrame, unk: str = UNK,
                  tok_col: str = "tok") -> DataFrame:
    """V2: token arrays -> id arrays; unknown words get the unknown id.
    Equi-joins only: on the token (AQE broadcasts a small vocabulary and
    splits hot tokens of a large one) and on the unknown label."""
    unk_id = vocab.where(F.col(tok_col) == unk).select(F.col(tok_col).alias("_u"), F.col("id").alias("_unk"))
    ex = docs.select(doc_col, F.posexplode(toks_col).alias("_p", tok_col)).withColumn("_u", F.lit(unk))
    j = ex.join(vocab.select(tok_col, "id"), tok_col, "left").join(F.broadcast(unk_id), "_u", "left")
    return (j.groupBy(doc_col)
            .agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("id", "_unk").alias("i")))).alias("_l"))
            .select(doc_col, F.transform("_l", lambda x: x["i"]).alias("ids")))


def label_ends(toks: Column, begin=(BEGIN,), end=(END,)) -> Column:
    """V4: begin and end labels around a token array."""
    return F.concat(F.array(*[F.lit(b) for b in begin]), toks, F.array(*[F.lit(e) for e in end]))


def pad_to(arr: Column, width: Column, fill) -> Column:
    """Right-pad an array with ``fill`` to ``width``."""
    return F.concat(arr, F.array_repeat(F.lit(fill), F.greatest(width - F.size(arr), F.lit(0)).cast("int")))


def array_depth(df: DataFrame, col: str) -> int:
    """How deep an array column is nested, from its type."""
    kind, n = df.schema[col].dataType, 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def pad_nested(df: DataFrame, col: str, fill, depth: int | None = None, out: str = "box") -> DataFrame:
    """V9: pad a ragged array of any depth to a box whose shape is the
    largest size of each level (one aggregate); ``fill`` is used on every level.
    A ``depth`` other than the column's is an error."""
    n = array_depth(df, col)
    if n == 0 or (depth is not None and depth != n):
        raise ValueError(f"column {col!r} is nested {n} deep, not {depth}")
    sizes, level = [F.size(col)], F.col(col)
    for _ in range(n - 1):
        sizes.append(F.array_max(F.transform(level, F.size)))
        level = F.flatten(level)
    top = df.agg(*[F.max(x).alias(f"d{i}") for i, x in enumerate(sizes)]).first()
    dims = [max(0, int(x or 0)) for x in top]

    def blank(k: int) -> Column:
        c = F.lit(fill)
        for d in reversed(dims[k:]):
            c = F.array_repeat(c, d)
        return c

    def padded(c: Column, k: int) -> Column:
        inner = c if k == n - 1 else F.transform(c, lambda x: padded(x, k + 1))
        return F.concat(inner, F.array_repeat(blank(k + 1), F.greatest(F.lit(dims[k]) - F.size(c), F.lit(0))))

    return df.withColumn(out, padded(F.col(col), 0))


def find(items: Column, value, start: int = 0, end: int | None = None) -> Column:
    """0-based index of the first ``value`` in ``items[start:end]``, null if none."""
    part = F.slice(items, F.lit(start + 1), (F.size(items) if end is None else F.lit(end)) - start)
    at = F.array_position(part, value)
    return F.when(at > 0, at + start - 1)


def ngrams(token: Column, n: int, labels: bool = True) -> Column:
    """V6/V7: windows of n items over ``[BEGIN] + chars + [END]``."""
    chars = F.regexp_extract_all(token, F.lit("(?s)."), 0)
    items = F.concat(F.array(F.lit(NGRAM_BEGIN)), chars, F.array(F.lit(NGRAM_END))) if labels else chars
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1))),
                       lambda i: F.slice(items, i, n))
