"""Spark queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

from tools.oracle_check import rows_of

import __spark_entry__ as E
from repairmine.sources.tables import TABLES

from .conftest import SF_SMALL

SUBSET = [
    "nearest_week", "edit_script", "script_round_trip", "clean_code", "collapse_blanks", "drop_blank_lines",
    "strip_comments", "encode_dict", "ref_names", "restore_lines", "token_offsets", "rebuild_text",
    "token_span", "cap_per_key", "balanced_sample", "three_way_split", "weighted_choice", "groups_with_both",
    "nearest_text", "mine_compile_errors", "mine_test_errors", "edit_plan", "apply_edits", "misspell",
    "word_vocab", "encode_words", "pad_ngrams", "pad_nested", "batches", "insert_ignore", "table_fingerprint",
    "stream_insert_ignore", "stream_retry",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert rows_of(cols, rows) == rows_of(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "week", "seq", "similar_week", "similar_seq", "distance"]
    assert df.count() >= 0
