"""Distances of id arrays and the nearest search over large groups, against
the full matrix and against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repairmine.operators import distance as D

ROWS = "id string, grp string, seq array<long>"


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_kernel_is_the_full_matrix(seed):
    r = random.Random(seed)
    for _ in range(120):
        a, b = (np.array([r.choice([1, 2, 3, -5, 1 << 62]) for _ in range(r.choice([0, 1, 5, 30, 90]))], dtype=np.int64)
                for _ in range(2))
        if r.random() < 0.5:
            b = np.concatenate([a[:r.randint(0, len(a))], b[:3], a[r.randint(0, len(a)):]])
        d = full(a.tolist(), b.tolist())
        assert D.edit_distance(a, b) == d
        for bound in (0, 1, 4, 40):
            assert D.edit_distance(a, b, bound) == (d if d <= bound else -1)


def test_distance_columns(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], []), (None, [1]), ([5] * 70, [6] * 90)], "a array<long>, b array<long>")
    got = df.select(D.token_distance(F.col("a"), F.col("b")).alias("d"), D.token_distance(F.col("a"), F.col("b"), 3).alias("k"))
    assert [(x.d, x.k) for x in got.collect()] == [(1, 1), (0, 0), (None, None), (90, -1)]


def by_pairs(fail, ok, bound):
    out = {}
    for i, g, s in fail:
        own = [(D.edit_distance(np.array(s), np.array(t)), j) for j, h, t in ok if h == g] if s is not None else []
        best = min(own, default=(-1, None))
        out[i] = (-1, None) if best[1] is None or (bound is not None and best[0] >= bound) else best
    return out


@pytest.mark.parametrize("bound", [None, 1, 7])
@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_nearest_over_ids(spark, bound, limit):
    """Ids that share their low bits (one symbol) are told apart; copies,
    ties, nulls, empty sequences."""
    r = random.Random(7)
    same = [5 + (k << 20) for k in range(4)]
    seq = lambda: [r.choice([1, 2, *same]) for _ in range(r.randint(0, 25))]
    fail = [(f"f{i}", "hot" if i % 3 else "g", seq()) for i in range(50)] + [("fn", "hot", None), ("fe", "hot", []), ("fx", None, [1])]
    ok = [(f"p{i:03d}", "hot" if i % 4 else "g", seq()) for i in range(70)]
    ok += [(f"q{i}", g, s) for i, (_, g, s) in enumerate(ok[:9])] + [("pn", "hot", None)]
    got = D.nearest_partner(spark.createDataFrame(fail, ROWS).repartition(3), spark.createDataFrame(ok, ROWS), ["grp"],
                            max_distance=bound, pair_limit=limit).collect()
    want = by_pairs([x for x in fail if x[1]], [x for x in ok if x[2] is not None], bound)
    assert len(got) == len(fail)
    assert {x.id: (x.distance, x.similar_id) for x in got} == {**want, "fx": (-1, None)}


def hot_group(n, length, families, seed=3):
    """Distinct sequences of one length: members of a family differ by a few
    changes, families do not resemble each other; some rows fit no family."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 60, (families, length))
    rows = base[np.arange(n) % families].copy()
    for x in rows[families:]:
        at = r.choice(length, r.integers(1, 4), replace=False)
        x[at] = r.integers(100, 1 << 40, len(at))
    rows[-n // 100:] = r.integers(0, 60, (n // 100 + (n % 100 > 0), length))[:n // 100 or 1]
    return np.unique(rows, axis=0)


def test_a_hot_group_compares_few_of_its_pairs(spark, monkeypatch):
    """20,000 distinct sequences of one length in one group: under 5 % of the
    pairs reach a distance; a sample of rows equals the search by all pairs."""
    rows = hot_group(20_000, 64, 250)
    order = np.random.default_rng(1).permutation(len(rows))
    fail, ok = rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]
    f = spark.createDataFrame([(f"f{i:05d}", "hot", x.tolist()) for i, x in enumerate(fail)], ROWS).repartition(8)
    p = spark.createDataFrame([(f"p{i:05d}", "hot", x.tolist()) for i, x in enumerate(ok)], ROWS).repartition(8)
    compared = []
    cells, tiles = D.cell_candidates, D.tile_candidates

    def count(pairs, bounded):
        compared.append((pairs, bounded))
        return pairs

    monkeypatch.setattr(D, "cell_candidates", lambda *a: count(cells(*a), True))
    monkeypatch.setattr(D, "tile_candidates", lambda *a: count(tiles(*a), False))
    got = {x.id: (x.distance, x.similar_id) for x in D.nearest_partner(f, p, ["grp"]).select("id", "distance", "similar_id").collect()}
    assert len(got) == len(fail)
    n = sum(pairs.count() if bounded else pairs.where("_low <= _most").count() if "_most" in pairs.columns else 0
            for pairs, bounded in compared)
    assert n < 0.05 * len(fail) * len(ok)
    for i in [*range(0, len(fail), 1500), *[k for k, x in enumerate(fail) if x.max() < 100][:4]]:
        near = [(D.edit_distance(fail[i], t), f"p{j:05d}") for j, t in enumerate(ok)
                if (fail[i] != t).sum() < 20 or got[f"f{i:05d}"][0] >= 20]
        assert got[f"f{i:05d}"] == min(near)
