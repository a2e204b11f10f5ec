"""Ids, written tables, streams and searches at sizes that one task, one
batch or one file would hide."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from repairmine.operators import distance as D
from repairmine.operators import edits as E
from repairmine.operators.vocab import dense_ids
from repairmine.session import file_stamps, materialize, table_exists, written_once
from repairmine.sources import sinks as S
from repairmine.streaming import jobs as R

from .conftest import SF_SMALL


@pytest.mark.parametrize("partitions", [1, 9])
def test_dense_ids_are_a_permutation_in_order(spark, partitions):
    n = 100_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("extra")).repartition(partitions)
    got = dense_ids(df, [F.col("k")], id_col="i")
    r = got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(r) == (n, n, 0, n - 1)
    rows = got.select("i", "k").orderBy("i").limit(3000).collect()
    keys = sorted(x["k"] for x in df.select("k").collect())[:3000]
    assert [x["k"] for x in rows] == keys
    # pruning a column must not change the ids
    assert got.select("i").distinct().count() == n and got.groupBy("extra").agg(F.sum("i").alias("s")).agg(
        F.sum("s")).first()[0] == n * (n - 1) // 2


def test_result_schemas(spark):
    assert len(S.RESULT_SCHEMAS) == 5
    for name, schema in S.RESULT_SCHEMAS.items():
        df = S.conform(spark.createDataFrame([("1",)], "id string"), name)
        assert df.schema.fieldNames() == schema.fieldNames() and df.first()["id"] == "1"
        if "distance" in df.columns:
            assert (df.first()["distance"], df.first()["similar_code"]) == (-1, "")


def test_append_ignore_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c")], "id string, code string")
    assert not table_exists(spark, path)
    assert S.append_ignore(spark, rows, path, "random_c_error_records", [F.col("code")]) == 2
    assert S.append_ignore(spark, rows, path, "random_c_error_records", [F.col("code")]) == 0
    assert sorted((x["id"], x["code"]) for x in spark.read.parquet(path).collect()) == [("1", "a"), ("2", "b")]


def test_written_once_sees_new_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    count = lambda: written_once(spark, "probe", [path], lambda: spark.read.parquet(path)).count()
    first = file_stamps(spark, path)
    assert count() == 3 and count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert file_stamps(spark, path) != first and count() == 5


def test_replayed_batch_gives_no_duplicate(spark, tmp_path):
    folder, out = R.split_files(spark, SF_SMALL, "events", "event_id"), str(tmp_path / "out")
    ckpt, seen = str(tmp_path / "ckpt"), []

    def handle(batch, bid):
        seen.append(bid)
        R.write_batch(batch, out, bid)

    def run():
        R.run_to_table(R.first_rows(R.table_stream(spark, folder), "user_id", ["ts", "event_id"]), handle, "replay", ckpt, "update")
    run()
    assert len(seen) > 2
    before = sorted(map(tuple, spark.read.parquet(out).select("event_id", "batch").collect()))
    # the commit of the last batch is lost: a restart runs that batch again
    for name in (str(max(seen)), f".{max(seen)}.crc"):
        if os.path.exists(f := os.path.join(ckpt, "commits", name)):
            shutil.move(f, str(tmp_path / name))
    run()
    assert seen.count(max(seen)) == 2
    assert sorted(map(tuple, spark.read.parquet(out).select("event_id", "batch").collect())) == before
    first = S.first_per_id(spark.read.parquet(out), [F.col("ts"), F.col("event_id")], "user_id")
    want = S.first_per_id(spark.read.parquet(f"{SF_SMALL}/events.parquet"), [F.col("ts"), F.col("event_id")], "user_id")
    assert sorted(x["event_id"] for x in first.collect()) == sorted(x["event_id"] for x in want.collect())


def lose_commit(ckpt, keep):
    """A run whose last batch was written but not committed."""
    last = max(int(n) for n in os.listdir(os.path.join(ckpt, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f := os.path.join(ckpt, "commits", name)):
            shutil.move(f, str(keep / name))
    return last


def test_replayed_batch_of_new_rows(spark, tmp_path):
    """The keys that an earlier batch brought are state: a repeated id does not
    come again, a replayed batch writes the same rows."""
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for k in range(3):
        spark.createDataFrame([(i, i % 4) for i in range(k * 5, k * 5 + 9)], "id long, grp int").coalesce(1).write.mode("append").parquet(folder)
    done, seen = spark.createDataFrame([(1,)], "grp int"), []

    def run():
        def handle(batch, bid):
            seen.append((bid, batch.count()))
            R.write_batch(batch, out, bid)
        R.run_to_table(R.new_rows(R.table_stream(spark, folder), "id", done, ["grp"]), handle, "new", ckpt)
    run()
    before = sorted(map(tuple, spark.read.parquet(out).select("id", "batch").collect()))
    assert [i for i, _ in before] == [i for i in range(19) if i % 4 != 1]
    last = lose_commit(ckpt, tmp_path)
    run()
    assert [b for b, _ in seen].count(last) == 2
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "batch").collect())) == before


def test_failed_rows_come_back_until_success_or_the_cap(spark, tmp_path):
    """A row that fails twice is seen in three batches; nothing is lost or
    seen twice when the last batch is replayed."""
    rows = [(1, "error", 1), (1, "purchase", 2), (1, "error", 3), (2, "error", 1), (2, "error", 2), (2, "error", 3),
            (2, "purchase", 4), (3, "error", 5), (4, "error", 1), (4, "error", 2), (4, "purchase", 3), (5, "purchase", 1)]
    tries = spark.createDataFrame(rows, "user_id int, event_type string, ts int")
    items, base = str(tmp_path / "items"), str(tmp_path / "loop")
    for k in (1, 2, 3, 4, 5):
        spark.createDataFrame([(k,)], "user_id int").coalesce(1).write.mode("append").parquet(items)
    check = R.verdict_check(tries, "user_id", ["ts"], F.col("event_type") == "purchase", 3)

    def run():
        ended, tried = R.retry_loop(spark, items, "user_id", check, 3, base)
        return (sorted(map(tuple, spark.read.parquet(ended).select("user_id", "try_count", "outcome").collect())),
                sorted(map(tuple, spark.read.parquet(tried).select("user_id", "try_count", "batch").collect())))
    ended, tried = run()
    assert ended == [(1, 1, "done"), (2, 3, "failed"), (3, 1, "waiting"), (4, 2, "done"), (5, 0, "done")]
    assert [t[:2] for t in tried] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2), (5, 0)]
    assert len({b for u, _, b in tried if u == 2}) == 3
    lose_commit(os.path.join(base, "log"), tmp_path)
    assert run() == (ended, tried)


def full_moves(a, b):
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), dtype=int)
    d[:, 0], d[0] = range(n + 1), range(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return d


@pytest.mark.parametrize("seed", range(4))
def test_banded_script_is_that_of_the_full_matrix(seed):
    r = random.Random(seed)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        d = full_moves(a, b)
        got = E._script_arrays(a, b, int(d[-1, -1]), list(a), list(b))
        i, j, want = len(a), len(b), []
        while i or j:
            if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
                if a[i - 1] != b[j - 1]:
                    want.append((E.CHANGE, j - 1, b[j - 1], a[i - 1]))
                i, j = i - 1, j - 1
            elif i and (not j or d[i, j] == d[i - 1, j] + 1):
                want.append((E.INSERT_BEFORE, j, "", a[i - 1]))
                i -= 1
            else:
                want.append((E.DELETE, j - 1, b[j - 1], ""))
                j -= 1
        assert list(zip(*got)) == want


def test_script_of_long_texts_is_banded():
    r = random.Random(1)
    a = [chr(65536 + r.randrange(300)) for _ in range(20_000)]
    b = list(a)
    for _ in range(25):
        b[r.randrange(len(b))] = "x"
    moves = E._moves(np.frombuffer("".join(a).encode("utf-32-le"), np.uint32),
                     np.frombuffer("".join(b).encode("utf-32-le"), np.uint32), 25)
    assert moves.nbytes < 2 << 20
    assert len(E._script_arrays("".join(a), "".join(b), 25, a, b)[0]) == sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("bound", [None, 4])
def test_nearest_by_bands_equals_by_pairs(spark, limit, bound):
    """One hot group: the band rounds and the direct comparison agree."""
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcd") for _ in range(r.randint(0, 40)))
    fail = [(f"f{i}", "hot" if i % 3 else "g", text()) for i in range(60)]
    ok = [(f"p{i}", "hot" if i % 4 else "g", text()) for i in range(60)]
    schema = "id string, grp string, seq string"
    got = D.nearest_partner(spark.createDataFrame(fail, schema), spark.createDataFrame(ok, schema), ["grp"],
                            max_distance=bound, bands=(2, 6), pair_limit=limit).collect()
    for x in got:
        best = min(((int(full_moves(x["seq"], s)[-1, -1]), i) for i, g, s in ok if g == x["grp"]), default=None)
        want = (-1, None) if best is None or (bound is not None and best[0] >= bound) else best
        assert (x["distance"], x["similar_id"]) == want


def test_nested_padding_of_three_levels(spark):
    from repairmine.operators import vocab as V
    df = spark.createDataFrame([(1, [[[1], [2, 3]], []]), (2, [[[4]], [[5]], [[6, 7]]]), (3, [])],
                               "i int, a array<array<array<int>>>")
    got = {x["i"]: x["box"] for x in V.pad_nested(df, "a", 0, depth=3).collect()}
    assert got[1] == [[[1, 0], [2, 3]], [[0, 0], [0, 0]], [[0, 0], [0, 0]]]
    assert got[2] == [[[4, 0], [0, 0]], [[5, 0], [0, 0]], [[6, 7], [0, 0]]]
    assert got[3] == [[[0, 0], [0, 0]]] * 3
    with pytest.raises(ValueError):
        V.pad_nested(df, "a", 0, depth=2)


def test_builders_and_statements(spark):
    from repairmine.plans.storage import run_statement
    df = spark.createDataFrame([(1, [(3, 4, "x", ""), (4, 1, "a", "b")])], f"i int, acts {E.ACTIONS_TYPE}")
    got = df.select(E.build_actions(F.col("acts"), {E.DELETE: lambda x: x["frm"]}, default=lambda x: x["to"]).alias("v")).first()
    assert got["v"] == ["x", "b"]
    assert run_statement(df, "count_rows").first()["n"] == 1
    with pytest.raises(KeyError):
        run_statement(df, "no such name")
