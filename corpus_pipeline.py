"""The corpus pipeline: five operators of ``repairmine.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared scratch folder and read as the next one's
``docs``. All but the last return the columns of ``documents``.

Defined results: null texts fail the quality rules; a document that loses all
its bytes to suffix-array dedup stays as an empty text; an empty table gives
no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.llm import bpe
from repairmine.llm.mixing import mix_documents, repeat_rows
from repairmine.llm.packing import pack_documents, packed_pieces
from repairmine.llm.quality import compression_bands
from repairmine.llm.simhash import one_of_each
from repairmine.llm.suffixes import cut_repeats
from repairmine.session import ensure_checkpoint_dir, materialize
from repairmine.sources.tables import read_table


#: What the third stage takes for a repeated passage. Fifty words are over
#: 200 bytes unless they have three letters or fewer on average.
PASSAGE_BYTES = 200
PASSAGE_WORDS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    ensure_checkpoint_dir(spark)
    return compression_bands(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    ensure_checkpoint_dir(spark)
    return one_of_each(docs).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages of ``PASSAGE_WORDS`` words or more that repeat,
    found as strings of ``PASSAGE_BYTES`` bytes; lengths follow. Shorter
    repeats (a phrase, a line of boilerplate) stay."""
    ensure_checkpoint_dir(spark)
    cut = cut_repeats(docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    return cut.select(*[
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ensure_checkpoint_dir(spark)
    return repeat_rows(mix_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    ensure_checkpoint_dir(spark)
    return packed_pieces(pack_documents(docs, bpe.tokenizer_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources", source_mix),
    ("packing", packing),
]

#: Fingerprints, seeded shuffles and tokenizer ids have no SQL form; tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a written table."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
