"""Quality rules: compression bands (operator 3).

A document is compressed with zstandard as a whole and in fixed chunks of
``CHUNK`` bytes (a last chunk under half of that joins the one before).
Ratio: raw bytes over compressed bytes. The limits depend on the length: a
text under the first band is too short to judge; above, a whole-document
ratio outside its band's limits, or any full-size chunk outside the chunk
limits, rejects the document (below: incompressible, above: repetitive).
Base rules come first: fewer than ``MIN_WORDS`` words, or over
``MAX_REPEAT_PERCENT`` percent of the words in five-word windows that the
text holds twice or more.

Defined results: null text has no words, so it fails the base rules and its
ratios are null; an empty table gives no rows; every input row gives one
row; an input column with a result's name is replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget
from .common import put

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEVEL = 3
CHUNK = 4096
#: (bytes from, least ratio, greatest ratio) of whole documents. Natural prose
#: compresses 1.1 to 1.6 times at 128 bytes and 2 to 3 times at length.
BANDS = ((128, 1.02, 4.0), (256, 1.12, 5.0), (1024, 1.3, 6.0), (4096, 1.4, 7.0), (16384, 1.5, 8.0))
CHUNK_LIMITS = (1.35, 7.0)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

_RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "doc_ratio double, min_chunk_ratio double, max_chunk_ratio double")


def repeat_words(words: list) -> int:
    """Words inside five-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 5 - max(i, covered)
            covered = i + 5
    return total


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def chunk_bounds(n: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    k = max(1, (n + chunk // 2) // chunk)
    return [(i * chunk, (i + 1) * chunk if i < k - 1 else n) for i in range(k)]


def measure(text: str | None, compressor) -> tuple:
    """The counts and ratios of one text, in the order of the result."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly space and 9 to 13
    counts = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
              dup_lines(text), repeat_words(words))
    if not raw:
        return (*counts, None, None, None)
    ratio = lambda b: len(b) / len(compressor.compress(b))
    whole = ratio(raw)
    bounds = chunk_bounds(len(raw))
    each = [ratio(raw[a:b]) for a, b in bounds] if len(bounds) > 1 else [whole]
    return (*counts, whole, min(each), max(each))


def compression_bands(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, ratios, ``base_failed``,
    ``band_failed`` and ``kept``."""

    @F.pandas_udf(_RESULT)
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard
        forget()
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in _RESULT.split(", ")]
        for s in texts:
            yield pd.DataFrame([measure(t, compressor) for t in s], columns=names)

    measured = measured.asNondeterministic()  # else a filter on a result evaluates it a second time
    text = F.col(f"`{text_col}`")
    m = F.col("__measured")
    size = F.octet_length(F.coalesce(text, F.lit("")))
    outside = F.lit(False)
    for least, low, high in BANDS:
        outside = F.when(size >= least, (m["doc_ratio"] < low) | (m["doc_ratio"] > high)).otherwise(outside)
    outside = outside | ((size >= CHUNK // 2) & (
        (m["min_chunk_ratio"] < CHUNK_LIMITS[0]) | (m["max_chunk_ratio"] > CHUNK_LIMITS[1])))
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    out = docs.withColumn("__measured", measured(text))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "doc_ratio", "min_chunk_ratio",
             "max_chunk_ratio"]
    return put(out, **{n: m[n] for n in names}, base_failed=base, band_failed=F.coalesce(outside, F.lit(False)),
               kept=~base & ~F.coalesce(outside, F.lit(False))).drop("__measured")
