"""Steps that must not grow with the input: Arrow steps, build sides, tasks."""

import hashlib
import itertools
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repairmine.operators import corrupt as M
from repairmine.operators import distance as D
from repairmine.operators import tokens as K
from repairmine.plans.corruption import SEED, q_shift_offsets, with_places
from repairmine.plans.text import q_token_span
from repairmine.plans.vocabulary import q_encode_ngrams, q_pad_ngrams
from repairmine.sources import submissions as S
from tests.test_corrupt import one_by_one


def test_arrow_steps_take_runs_of_rows(monkeypatch):
    monkeypatch.setattr(K, "STEP_VALUES", 10)
    seen = []

    def step(x, y):
        seen.append(len(x.flatten()))
        return pa.array([sum(a or []) + b for a, b in zip(x.to_pylist(), y.to_pylist())], pa.int64())
    rows = [[1] * 4, None, [2] * 4, [3] * 25, [], [4] * 9, [5]]
    got = K.in_runs(step, pa.array(rows, pa.list_(pa.int64())), pa.array(range(7)))
    assert got.to_pylist() == [sum(r or []) + i for i, r in enumerate(rows)]
    assert seen == [8, 25, 10]
    assert K.in_runs(step, pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64())).to_pylist() == []


def test_places_do_not_depend_on_runs(spark):
    texts = ["", "a\n b", None, "x\n" * (K.STEP_VALUES + 7), "/* c\n */ int y ;", "z z\nz"]
    df = K.with_tokens(spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1), "t")
    got = {r.i: r for r in df.select("i", F.size("tokens").alias("n"), F.try_element_at("tokens", F.lit(-1)).alias("e")).collect()}
    for i, text in enumerate(texts):
        words = [] if not text else list(re.finditer(r"(?s)/\*.*?\*/|\w+|;", text))
        words = [w for w in words if not w.group().startswith("/*")]
        assert (got[i].n or 0) in (len(words), -1)
        if words:
            at = words[-1].start()
            assert (got[i].e.off, got[i].e.line) == (at, text[:at].count("\n") + 1)


def test_submissions_are_dealt_to_tasks(spark, tmp_path):
    spark.range(S.ROWS_A_TASK * 2 + 1).selectExpr(
        "id o_orderkey", "id % 9 o_custkey", "'F' o_orderstatus", "'1-URGENT' o_orderpriority",
        "date'1995-01-01' o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = S.dealt_submissions(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == 3 and max(r["count"] for r in rows) <= S.ROWS_A_TASK * 1.1


def test_token_span_tokenizes_a_text_once(spark, tmp_path):
    spark.range(40).selectExpr(
        "id o_orderkey", "id % 9 o_custkey", "'F' o_orderstatus", "'1-URGENT' o_orderpriority",
        "date'1995-01-01' o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = q_token_span(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("#include[^") == 1
    rows = got.collect()
    assert rows and all(r.e > r.b for r in rows)


@pytest.mark.parametrize("query", [q_encode_ngrams, q_pad_ngrams])
def test_ngram_rows_are_not_broadcast(spark, tmp_path, query):
    rows = [(1, "ab b"), (2, ""), (3, None), (None, "b"), (4, "c"), (4, "ab b")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = query(spark, str(tmp_path))
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert joins and all("_pid" in x for x in joins)
    told = {r[0]: r[1] for r in got.collect()}
    # sorted: <BEGIN>-<END>, <BEGIN>-a, <BEGIN>-b, <BEGIN>-c, ab, b-<END>, c-<END>
    if query is q_encode_ngrams:
        assert told == {1: "1,4,5|2,5", 2: "0", None: "2,5", 4: "1,3,4,6,5|2,5"}
    else:
        assert told == {1: "1,4,5,0|2,5,0,0", 2: "0,0,0,0|0,0,0,0", None: "2,5,0,0|0,0,0,0", 4: "1,3,4,6,5|2,5,0,0"}


def test_a_draw_is_computed_once(spark):
    """Of one edit: action, position, kind of change, class, word and misspelling, not each at every mention."""
    toks, doc, d = F.col("toks"), F.col("doc"), F.col("d")
    assert str(M.random_edit(toks, F.col("idents"), 1, doc, d)).count("md5(") < 20
    for kind in ("identifier", "brace", "pointer"):
        assert str(M.mutator_edits(kind, toks, F.col("idents"), 1, doc, d)).count("md5(") < 20


def test_plans_are_full_after_many_draws(spark):
    """One token can be changed or deleted once; the rest of a plan are inserts, drawn until it is full."""
    df = spark.range(60).select("id", F.array(F.lit("x")).alias("toks"))
    got = M.with_edit_plan(df, "id", "toks", 3).select(M.edit_count(3, F.col("id")).alias("k"), "plan").collect()
    assert all(len(r.plan) == r.k and sum(e.act != 1 for e in r.plan) <= 1 for r in got)
    draws = [[e.draw for e in r.plan] for r in got]
    assert all(x == sorted(set(x)) for x in draws) and max(x[-1] for x in draws) > M.STRETCHES[2]
    assert M.STRETCHES[-1] == M.TRIES


def test_scripts_are_made_once_a_pair(spark, monkeypatch):
    """Copies share a pair: its script is made once, in tasks of a bounded number of pairs."""
    from repairmine.plans import mining as P
    seen = []
    made = P.with_script_arrow

    def counted(df, *a, **k):
        seen.append((df.count(), df.rdd.getNumPartitions()))
        return made(df, *a, **k)
    monkeypatch.setattr(P, "with_script_arrow", counted)
    monkeypatch.setattr(P, "SCRIPTS_A_TASK", 1)
    rows = [(f"f{i:03}", "g", "x", 7, ["a"] * (i % 3) + ["b"], "c") for i in range(90)]
    rows += [("p1", "g", "x", 1, ["b"], "one"), ("p2", "g", "x", 1, ["b"], "two"), ("f100", "h", "x", 7, ["b"], "c")]
    c = spark.createDataFrame(rows, "id string, problem_user_id string, refs string, status_code int, toks array<string>, code string")
    c = c.withColumn("seq", P.token_ids(F.col("toks")))
    got = {r.id: r for r in P.with_scripts(P.nearest(c, [7], [1], None), c).collect()}
    assert seen == [(3, 3)] and len(got) == 91
    for i in range(90):
        r = got[f"f{i:03}"]
        assert (r.distance, r.similar_code, r.applied) == (i % 3, "one", r.toks) and len(r.acts) == i % 3
    assert (got["f100"].distance, got["f100"].similar_code, got["f100"].acts) == (-1, None, None)


def test_submissions_are_dealt_unsorted_and_equal_rows_part(spark, tmp_path):
    """A row group is one task: it must not be sorted to be dealt, and equal rows must not meet."""
    spark.range(S.ROWS_A_TASK * 2 + 1).selectExpr(
        "7L o_orderkey", "9L o_custkey", "'F' o_orderstatus", "'1-URGENT' o_orderpriority",
        "date'1995-01-01' o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = S.dealt_submissions(spark, str(tmp_path))
    plan = df.where(F.col("code").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [x for x in plan.splitlines() if "Filter" in x and "repeat(" in x]
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in rows) == S.ROWS_A_TASK * 2 + 1
    assert len(rows) == 3 and max(r["count"] for r in rows) <= S.ROWS_A_TASK * 1.1


def test_pairs_of_a_hot_cell_are_dealt(spark, monkeypatch):
    """One group, one cell: its pairs come once each, in tasks of a bounded number of them."""
    monkeypatch.setattr(D, "TILE", 16)
    monkeypatch.setattr(D, "PAIRS_A_TASK", 1000)
    fa = spark.range(200).selectExpr("'g' grp", "id _fid")
    pb = spark.range(150).selectExpr("'g' grp", "id _rank")
    met = D.met_in_blocks(fa, pb, ["grp"]).withColumn("p", F.spark_partition_id())
    tasks = [r["count"] for r in met.groupBy("p").count().collect()]
    assert sum(tasks) == 30_000 == met.select("_fid", "_rank").distinct().count()
    assert len(tasks) >= 20 and max(tasks) < 6000


def test_equal_sequences_are_not_compared(spark, monkeypatch):
    """A failing sequence that passed elsewhere in its group meets no other."""
    seen = []
    tasks = D.tasks_of
    monkeypatch.setattr(D, "tasks_of", lambda df, pairs: seen.append(df.agg(F.sum(pairs)).first()[0] or 0) or tasks(df, pairs))
    shape = "id string, grp string, seq array<long>"
    fail = [(f"f{i}", "g", [i, 1]) for i in range(50)] + [("f50", "g", [7, 8, 9]), ("f51", "g", None), ("f52", "h", [1])]
    ok = [(f"p{i:02}", "g", [i, 1]) for i in range(50)] + [("p99", "g", [3, 1]), ("p98", None, [7, 8, 9])]
    near = D.nearest_partner(spark.createDataFrame(fail, shape), spark.createDataFrame(ok, shape), ["grp"])
    got = {r.id: (r.distance, r.similar_id) for r in near.collect()}
    assert seen == [50]
    assert got == {**{f"f{i}": (0, f"p{i:02}") for i in range(50)}, "f50": (2, "p07"), "f51": (-1, None), "f52": (-1, None)}


def test_copies_are_collapsed_before_a_group_meets(spark, monkeypatch):
    """Passing rows are collapsed where they are read, failing ones are counted: a problem-user is no task."""
    from repairmine.plans import mining as P
    seen = []
    search = P.nearest_partner

    def watched(failing, passing, *a, **k):
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (failing, passing)]
        seen.append((failing.count(), sum("Join" in x for x in plans)))
        return search(failing, passing, *a, **k)
    monkeypatch.setattr(P, "nearest_partner", watched)
    rows = [(f"f{i}", "g", "x", 3, [1]) for i in range(40)] + [(f"n{i}", "g", "x", 3, None) for i in range(3)]
    rows += [("far", "g", "x", 3, [5, 6, 7]), ("other", "g", "y", 3, [1]), ("alone", "h", "x", 3, [1])]
    rows += [(f"p{i}", "g", "x", 1, [2]) for i in range(40)] + [("q", "k", "x", 1, [1])]
    c = spark.createDataFrame(rows, "id string, problem_user_id string, refs string, status_code int, seq array<long>")
    got = {r.reason: r.n for r in P.miss_reasons(c, [3], [1], 2).collect()}
    assert got == {"found": 40, "no_tokens": 3, "none_within_bound": 1, "no_candidate": 1}
    assert seen == [(5, 0)]
    near = P.nearest(c, [3], [1], None, P.groups_with_both(c, [1], [3])).collect()
    assert seen[1][1] == 0 and sorted(r.id for r in near) == sorted(x[0] for x in rows if x[3] == 3 and x[1] == "g")


def test_sums_before_each_value(spark):
    """Stretches of stretches: any length, and no Python step."""
    rows = [(n, [(7 * i + n) % 11 - 5 for i in range(n)]) for n in (0, 1, 15, 16, 17, 256, 4097, 70_000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n long, x array<long>")
    zero = F.lit(0).cast("bigint")
    sums = df.select("n", K.before_each(F.col("x"), lambda a, b: a + b, zero).alias("s"))
    assert {r.n: r.s for r in sums.collect()} == {
        n: x if x is None else [0, *itertools.accumulate(x)][:n] for n, x in rows}
    last = df.select("n", K.before_each(F.transform("x", lambda v: F.when(v > 3, v)), lambda a, b: F.coalesce(b, a),
                                        F.lit(None).cast("bigint")).alias("s"))
    for r in last.where("n >= 0").collect():
        seen, old = [], None
        for v in dict(rows)[r.n]:
            seen.append(old)
            old = v if v > 3 else old
        assert r.s == seen


def test_places_in_expressions_equal_arrow_ones(spark):
    texts = ["", None, "a\n b", "/* c\n\n */ int y ;", "\u00e4 \U0001f600\n// x\n\r\n\"\U0001f600\" z  ", " \n", "x\n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    df = df.select("i", K.gaps_of(F.col("t")).alias("g"), K.tokens_of(F.col("t")).alias("k"))
    got = df.select("i", K.row_places(F.col("g"), F.col("k")).alias("own"), K.places_of(F.col("g"), F.col("k")).alias("arrow"))
    for r in got.collect():
        assert (r.own.off, r.own.line) == (r.arrow.off, r.arrow.line)
    assert [r.own.off for r in got.where("i in (1, 2)").orderBy("i").collect()] == [[], [0, 3]]


def test_shift_offsets_rows_do_not_wait_for_python(spark, tmp_path):
    """An Arrow function keeps every row that is on its way, on disk if need be, with all its columns."""
    texts = ["int a = 1 ;\n/* \n */ return b ;", "x", "", None, "y\n" * 900, "x"]
    rows = [(i // 2 if i < 6 else None, t) for i, t in enumerate(texts + ["f ( ) ;", "g = h"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_shift_offsets(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan and plan.count("#include[^") == 2
    docs = with_places(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    expected = []
    for r in M.with_edit_plan(docs, "doc_id", "toks", SEED).where("size(toks) > 0").collect():
        new = one_by_one(list(zip(r.toks, r.places.off, r.places.line)), [tuple(e) for e in r.plan])
        if new:
            coords = ",".join(f"{off}:{line}" for _, off, line in new)
            expected.append((r.doc_id, len(new), hashlib.md5(coords.encode()).hexdigest()))
    told = [tuple(r) for r in got.collect()]
    assert len(told) >= 4 and Counter(told) == Counter(expected)
