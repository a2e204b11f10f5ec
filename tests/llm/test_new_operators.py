"""Prefix trie, ranked search and secret scan against SQL and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest

from repairmine.llm import blockmax, prefixtrie, secrets
from repairmine.llm.queries import ORACLES, QUERIES
from tools.oracle_check import rows_of

from ..conftest import SF_SMALL


def against_sql(spark, name, table_names, sf=SF_SMALL):
    con = duckdb.connect()
    for t in table_names:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    return rows_of(df.columns, [tuple(x) for x in df.collect()]), rows_of([c[0] for c in cur.description], cur.fetchall())


# --- 11 prefix trie ---------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, DEPTH int, conv string, t1 int"


def rebuilt(rows):
    """Conversations as lists of turns, on the heads of their hundred's first."""
    import zlib
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = Counter()
    children = Counter(k[:-1] for k in members if k)
    for k, m in members.items():
        below = [n for n in members if n[:len(k)] == k]
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[n] for n in below),
             sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


def run_trie(spark, rows, part):
    turns = prefixtrie.marked_turns(spark.createDataFrame(rows, TURNS).repartition(5))
    from pyspark.sql import functions as F
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    got = prefixtrie.prefix_trie(*prefixtrie.borrow_heads(turns, F.col("conv") - F.col("conv") % 100, head, 5), part=part)
    return Counter(tuple(x) for x in got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_matches_sql(spark):
    got, want = against_sql(spark, "op11_prefix_trie", ["conversations"])
    assert got == want and len(got) > 10


def odd_turns():
    """Nulls, ties, repeated rows, a hot first turn, copies, an absent hundred."""
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(305, 320), -7, -120]:
        for t in range(r.randint(1, 9)):
            turn = None if r.random() < 0.05 else r.choice([t, t, t, 0])
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ñandú"]) if t else "hello"))
    rows += rows[10:14] + [(None, 1, "user", "nobody")]
    rows += [(c, t, "user", "same") for c in range(400, 430) for t in range(7)]
    return [(*x, 1, "x", 2) for x in rows]


def test_trie_of_odd_rows_through_every_level(spark):
    rows = odd_turns()
    want = trie(rebuilt(rows))
    assert run_trie(spark, rows, part=prefixtrie.PART) == want
    assert run_trie(spark, rows, part=40) == want


def test_long_chain_and_empty_table(spark, monkeypatch):
    """One conversation of many slices holds most rows."""
    monkeypatch.setattr(prefixtrie, "SLICE", 16)
    rows = [(1, t, "user", str(t % 3), 1, "x", 2) for t in range(150)]
    rows += [(c, t, "user", str(t % 3), 1, "x", 2) for c in (101, 102) for t in range(120)]
    assert run_trie(spark, rows, part=60) == trie(rebuilt(rows))
    assert not run_trie(spark, [], part=60)


def test_settling_in_memory_equals_sums():
    """Random trees, weights over the rows of their subtrees."""
    r = random.Random(2)
    for n in (1, 2, 7, 60):
        up = [-1] + [r.randrange(max(0, i - 3), i) for i in range(1, n)]
        own, leaves, saved = [r.randint(1, 9) for _ in up], [r.randint(0, 1) for _ in up], [r.randint(0, 50) for _ in up]
        sums = []
        for x in (own, leaves, saved):
            s = list(x)
            for i in range(n - 1, 0, -1):
                s[up[i]] += s[i]
            sums.append(s)
        got = prefixtrie.settle({
            "k1": list(range(n)), "k2": [0] * n, "p1": [p if p >= 0 else None for p in up], "p2": [0] * n,
            "weight": list(sums[0]), "leaves": leaves, "saved": saved, "add_leaves": [0] * n, "add_saved": [0] * n})
        assert got.column(2).to_pylist() == sums[1] and got.column(3).to_pylist() == sums[2]


# --- 12 ranked search -------------------------------------------------------

WORDS = "the of river stone über ñandú re-pair shard 12 x the the of".split()


def texts(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", "\n", "--", "\t", "_"]) for _ in range(n))


def terms(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(blockmax.TERM_PATTERN, low)


def ranking(docs, items, top):
    """Every score of every document, by the formula."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(terms(t))
    for item, ts in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in ts if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for k, (s, none, i) in enumerate(sorted(scores)[:top]):
            out[(item, k + 1, None if none else i, -s)] += 1
    return out


def search_rows():
    r = random.Random(8)
    docs = [(i, texts(r, r.randint(1, 80))) for i in range(400)] + [(i, "stone " * (i % 9)) for i in range(400, 500)]
    docs += docs[:20] + [(None, "river river"), (None, None), (900, ""), (901, " \n--"), (902, texts(r, 40_000)), (3, "same id"),
                         (903, "ÀÉ ǅ K river")]
    items = [(i, texts(r, 6)) for i in range(12)] + [(20, None), (21, "--"), (22, "absent"), (23, "RIVER"), (None, "stone"), (0, "x x"),
                                                     (24, "ÀÉ k")]
    return docs, items


def test_search_matches_sql(spark):
    got, want = against_sql(spark, "op12_block_max_search", ["documents", "benchmark"])
    assert got == want and len(got) > 100


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 20])
def test_search_matches_brute_force(spark, shard_bytes):
    docs, items = search_rows()
    d = spark.createDataFrame([(*x, 1, 2.0) for x in docs], "doc_id long, text string, SCORE int, terms double").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = blockmax.search(blockmax.build_index(d, shard_bytes=shard_bytes), q, top=15)
    assert Counter(tuple(x) for x in got.collect()) == ranking(docs, items, 15)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert blockmax.search(blockmax.build_index(d), q).count() == 0
    full = blockmax.build_index(spark.createDataFrame([(1, "river")], "doc_id long, text string"))
    assert blockmax.search(full, q.where("false")).count() == 0


def test_blocks_are_rejected_before_they_are_decoded(monkeypatch):
    """Small blocks, a rare strong term and a common weak one: the search
    equals the full sum and leaves blocks of the common list alone."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    docs = [(i, "common " * (1 + (i % 64 == 0) * 9) + ("rare " if i % 97 == 0 else "") + "pad " * (i % 5)) for i in range(2000)]
    row = blockmax.build_shard(list(docs))
    asked = [b"common", b"rare"]
    s = blockmax.Shard(row, pa.array(asked), row["docs"], row["terms"])
    weights = np.array([3, 4000])
    cand, score = blockmax.search_shard(s, np.array([0, 1]), weights, 0)
    bar = int(np.sort(score)[-10])
    s = blockmax.Shard(row, pa.array(asked), row["docs"], row["terms"])
    few, best = blockmax.search_shard(s, np.array([0, 1]), weights, bar)
    assert sorted(zip(few, best)) == sorted((c, x) for c, x in zip(cand, score) if x >= bar)
    blocks = int(s.block_at[s.where[0] + 1] - s.block_at[s.where[0]])
    touched = sum(s.block_at[s.where[0]] <= b < s.block_at[s.where[0] + 1] for b in s.decoded)
    assert 0 < touched < blocks / 4


# --- 13 secrets -------------------------------------------------------------

RANKS = secrets.ranked(["river", "stone", "haus"])


def test_cheapest_segmentation_is_the_minimum_over_all():
    r = random.Random(1)
    bits = ["river", "St0ne", "4", "qwe", "rt", "2019", "-", "x", "x", "Z", "stone", "ab", "ab", "ß", "12", "20190506", "İ"]
    for _ in range(200):
        v = "".join(r.choice(bits) for _ in range(r.randint(1, 8)))
        named = list(secrets.segments(v, RANKS))

        @lru_cache(None)
        def cost(i):
            if i == len(v):
                return 0.0
            tries = [secrets.SEGMENT + sum(map(secrets._char, v[i:j])) + cost(j) for j in range(i + 1, len(v) + 1)]
            return min(tries + [secrets.SEGMENT + c + cost(e) for a, e, _, c in named if a == i])

        got, way = secrets.guess_cost(v, RANKS)
        assert got == pytest.approx(cost(0)) and "".join(v[a:b] for a, b, _ in way) == v


def test_kinds_of_segments():
    kind = lambda v: [k for _, _, k in secrets.guess_cost(v, RANKS)[1]]
    assert kind("P4ssw0rd") == ["word"] and kind("12345678") == ["walk"] and kind("2019-05-06") == ["date"]
    assert kind("xxxxxxxxxxxx") == ["repeat"] and kind("k8#z!x") == ["brute"] and kind("river2019") == ["word", "date"]


def test_costly_values_of_contexts_are_found():
    def found(t):
        return [t[a:b] for k, a, b, _ in secrets.scan_text(t, RANKS) if k == 3]
    assert found('é pwd = "kJ8#qz!xW2"; x') == ["kJ8#qz!xW2"]
    assert found("postgres://user:Zk9!mmQ2xx@host/db") == ["Zk9!mmQ2xx"]
    assert found("run --token 9fK2mmQ0Pz now") == ["9fK2mmQ0Pz"]
    assert found("Authorization: Bearer aB3.dE5-gH7") == ["aB3.dE5-gH7"]
    assert found("password: changeme, pin = 12345678, secret='xxxxxxxxxxxx', pwd: River, login: 2019-05-06") == []
    assert found("nothing here = kJ8#qz!xW2") == []


def base_by_re(t):
    """The fixed patterns, on text."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t, re.A) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets_of_odd_rows(spark):
    r = random.Random(4)
    bits = ["password", "PassWD", "apiKey", "api_key", "token", "=", ":", " ", "\"", "'", "AKIA", "AKIAABCDEFGHIJ1234", "deadbeef",
            "0123456789abcdef", "x" * 12, "é", "ſecret", "toKen", "\n", "secret=token=", "abcdefghijkl"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += rows[:3] + [(None, None), (5, ""), (6, "a1" * 300_000), (None, "token: " + "k9" * 50)]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, N_HEX int, spans int, kind int").repartition(3)
    got = secrets.find_secrets(docs, ["river"]).collect()
    assert len(got) == len(rows)
    assert Counter((x.doc_id, x.text) for x in got) == Counter(rows)
    for x in got:
        want = base_by_re(x.text or "")
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        kept = [s for s in x.spans.split(",") if s and not s.startswith("guess")]
        assert ",".join(kept) == told and x.n_guess == x.spans.count("guess")
        assert all(math.isfinite(f.cost) and f.cost >= secrets.COST for f in x.findings if f.kind == "guess")
    assert secrets.find_secrets(docs.where("false"), []).count() == 0


def test_frequent_words_count_all_texts(spark):
    rows = [("River river-STONE",), ("stone river ab 12",), (None,), ("über über",)]
    docs = spark.createDataFrame(rows, "text string").repartition(2)
    assert secrets.frequent_words(docs, words=3) == ["river", "stone", "über"]


# --- pipeline: repeated passages ---------------------------------------------

def test_passage_stage_cuts_passages_of_over_fifty_words(spark):
    """Passages of 51 to 70 words that two documents share go; shorter ones
    and clean, null and empty texts stay as they are."""
    import corpus_pipeline
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = [prose(n) for n in (51, 55, 70)], prose(40)
    texts = [f"{prose(90)} {p} {prose(30)}" for p in long for _ in range(2)]
    texts += [f"{prose(60)} {short} {prose(20)}" for _ in range(2)] + [prose(200), None, "", "é " * 5]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x.doc_id: x for x in corpus_pipeline.passage_dedup(spark, docs, SF_SMALL).collect()}
    assert len(got) == len(texts)
    for i in range(6):
        assert long[i // 2] not in got[i].text and got[i].n_chars == len(got[i].text) > 400
    assert all((got[i].text or "") == (texts[i] or "") for i in range(6, len(texts)))
    assert corpus_pipeline.passage_dedup(spark, docs.where("false"), SF_SMALL).count() == 0
