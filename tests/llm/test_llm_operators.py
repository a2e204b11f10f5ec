"""The training-data operators against brute-force versions, and edge cases:
nulls, empty and very long texts, ties, repeated rows, empty tables, extra
columns whose names clash with results."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest

from repairmine.llm import bpe, chat, components, kdtree, licences, mixing, nndescent, packing, quality, repair, simhash
from repairmine.llm import suffixes
from repairmine.llm.queries import ORACLES, QUERIES
from tools.oracle_check import rows_of

from ..conftest import SF_SMALL

WORDS = "the of and licence river stone über ñandú re-pair shard 12 x".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty and blank texts, one long text, repeats and ties."""
    r = random.Random(3)
    base = [(i, text(r, r.randint(1, 60)), "en", f"s{i % 3}", i) for i in range(40)]
    return base + base[:3] + [(100, None, None, None, None), (101, "", "de", "s1", 0), (102, " \t\n", "de", "s1", 3),
                              (None, "no id here", None, "s2", 1), (103, text(r, 30_000), "en", "s0", 9),
                              (104, "<|endoftext|> a  b   c d \x1c e'll 日本語\n\n", "en", None, 5), (7, "same id, other text", "fr", "s1", 2)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, DOCS).repartition(3)
    # names that results use, in another case
    return df.selectExpr("*", "1 as SHARD", "2 as slot", "3 as kept", "4 as target", "5 as n_bytes", "6 as th", "7 as _size", "8 as copies",
                         "9 as spans")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_path())
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4")


# --- registration -----------------------------------------------------------

def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(ORACLES) <= set(QUERIES)


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF_SMALL}/conversations.parquet'")
    df = QUERIES["op8_relational_chat"](spark, SF_SMALL)
    cur = con.execute(ORACLES["op8_relational_chat"])
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


# --- 1 sharding -------------------------------------------------------------

def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kdtree.shard_files(docs, dimensions=["doc_id", "n_chars", "source", "lang"], shards=8).select(
        "doc_id", "size", "shard", "slot").collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in docs.select("doc_id").collect())
    size = Counter()
    for x in got:
        size[x.shard] += x["size"]
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(abs(v - mean) for v in size.values()) < 0.03 * mean
    for k in size:
        slots = sorted(x.slot for x in got if x.shard == k)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_rows(odd, odd_rows, none):
    got = kdtree.assign_shards(odd, ["doc_id", "lang", "n_chars"], shards=4).collect()
    assert len(got) == len(odd_rows) and all(0 <= x.shard < 4 for x in got)
    assert all(x["size"] == len((x.text or "").encode()) + 1 for x in got)
    same = {}
    for x in got:
        same.setdefault((x.doc_id, x.text), set()).add(x.shard)
    assert all(len(v) == 1 for v in same.values())
    assert kdtree.assign_shards(none, ["doc_id"], shards=8).count() == 0


def test_median_among_equal_values(spark):
    """One value holds most rows: the cut goes through its ties."""
    docs = spark.createDataFrame([(i, "x" * 9, "en", "a" if i % 10 else "b", 1) for i in range(4000)], DOCS)
    got = kdtree.assign_shards(docs, ["source"], shards=4).groupBy("shard").count().collect()
    assert len(got) == 4 and all(abs(x["count"] - 1000) < 20 for x in got)


def test_leaves_reach_target_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "en", "a", 1) for i in range(3000)], DOCS)
    total = sum(i % 50 + 1 for i in range(3000))
    got = kdtree.assign_shards(docs, ["doc_id"], target_bytes=total / 11).groupBy("shard").sum("size").collect()
    assert all(x["sum(size)"] <= 1.5 * total / 11 for x in got)


def brute_leaves(points, most):
    """Leaves of a plain tree over ``(x, y)`` points of equal weight."""
    extent = [max(p[d] for p in points) - min(p[d] for p in points) for d in (0, 1)]

    def split(part):
        if len(part) <= most:
            return [part]
        width = [(max(p[d] for p in part) - min(p[d] for p in part)) / extent[d] for d in (0, 1)]
        part = sorted(part, key=lambda p: p[0 if width[0] >= width[1] else 1])
        return split(part[:len(part) // 2]) + split(part[len(part) // 2:])
    return split(points)


def test_many_leaves_equal_a_plain_tree(spark):
    r = random.Random(4)
    points = list(zip(r.sample(range(10 ** 6), 4096), r.sample(range(10 ** 6), 4096)))
    docs = spark.createDataFrame([(x, "", "en", "a", y) for x, y in points], DOCS)
    got = {}
    for x in kdtree.assign_shards(docs, ["doc_id", "n_chars"], target_bytes=16.0).collect():
        got.setdefault(x.shard, []).append((x.doc_id, x.n_chars))
    assert [sorted(got[k]) for k in sorted(got)] == [sorted(p) for p in brute_leaves(points, 22)] and len(got) == 256


# --- 2 Re-Pair --------------------------------------------------------------

def test_token_files_round_trip(odd, odd_rows, none, library):
    got = repair.token_files(odd, bpe.tokenizer_path(), block_tokens=5000).collect()
    rows = sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for x, row in zip(sorted(got, key=lambda x: x.start), rows):
        ids = library(row[1])
        assert (x.doc_id, x.start, x.n_tokens) == (row[0], at, len(ids))
        assert bytes(x.ids) == ids.tobytes() and x.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert len(got) == len(rows) and repair.token_files(none, bpe.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_repair_decodes_and_shrinks(seed):
    r = np.random.default_rng(seed)
    motif = r.integers(0, 40, 12)
    parts = [np.concatenate([motif if r.random() < 0.6 else r.integers(0, 40, r.integers(1, 9))
                             for _ in range(r.integers(0, 30))] + [np.zeros(1, int)]) for _ in range(60)]
    ids, tokens = np.concatenate(parts), np.array([len(p) for p in parts])
    symbols, own, left, right = repair.compress(ids, tokens, 100, min_count=4)
    lengths = repair.rule_lengths(left, right, 100)
    assert len(symbols) < 0.7 * len(ids) and own.sum() == len(symbols)
    assert (repair.expand(symbols, left, right, 100) == ids).all()
    assert (repair.Expander(left, right, lengths, 100)(symbols) == ids).all()
    row = {"base": 100, "rules": np.stack([left, right], 1).astype("<u4").tobytes(),
           "rule_tokens": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(), "doc_symbols": own.tolist()}
    for d, p in enumerate(parts):
        a = int(r.integers(0, len(p)))
        b = int(r.integers(a, len(p) + 1))
        assert (repair.decode_range(row, d, a, b) == p[a:b]).all()


def pair_counts(symbols, own):
    docs = np.split(symbols, np.cumsum(own)[:-1])
    return Counter(p for d in docs for p in zip(d[:-1].tolist(), d[1:].tolist()))


@pytest.mark.parametrize("base", [50, 65_530])
def test_no_frequent_pair_is_left(base):
    """Long passages become one symbol, also past 65,535 symbols."""
    r = np.random.default_rng(1)
    passages = r.integers(0, 50, (4, 64))
    parts = [np.concatenate([passages[r.integers(4)] if r.random() < 0.7 else r.integers(0, 50, r.integers(1, 9))
                             for _ in range(r.integers(1, 20))]) for _ in range(80)]
    ids, tokens = np.concatenate(parts), np.array([len(p) for p in parts])
    symbols, own, left, right = repair.compress(ids, tokens, base)
    assert max(pair_counts(symbols, own).values()) < repair.MIN_COUNT
    assert (repair.expand(symbols, left, right, base) == ids).all() and own.sum() == len(symbols)
    assert repair.rule_lengths(left, right, base).max() >= 64 and (base < 1000 or base + len(left) > 1 << 16)


def test_encoder_equals_the_library(library):
    r = random.Random(8)
    chars = "abcXYZ  \n\t.,'!?0189éüß—日 \x1c <|>"
    enc = bpe.Encoder(bpe.tokenizer_path())
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["<|endoftext|>", "I'll  we've\n\n it's 'S  ", "a" * 5000, " " * 300]
    for t, b in zip(texts, enc.encode(texts)):
        assert (np.frombuffer(b, enc.dtype) == library(t)[:-1]).all(), repr(t)


def test_encoder_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "GENERATION", 50)
    enc, r = bpe.Encoder(bpe.tokenizer_path()), random.Random(1)
    for _ in range(20):
        texts = [text(r, 20) + " " + " ".join(f"w{r.randint(0, 500)}" for _ in range(40)) for _ in range(5)]
        assert all((np.frombuffer(b, enc.dtype) == library(t)[:-1]).all() for t, b in zip(texts, enc.encode(texts)))


# --- 3 quality --------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    on = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(on)


def test_counts_of_odd_rows(odd, odd_rows, none):
    got = quality.compression_bands(odd.where("doc_id <> 103 or doc_id is null")).collect()
    assert len(got) == len(odd_rows) - 1
    for x in got:
        want = brute_counts(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert x.kept == (not x.base_failed and not x.band_failed)
    assert quality.compression_bands(none).count() == 0


def test_bands_reject_repetitive_and_incompressible(spark):
    r = random.Random(4)
    prose = " ".join("".join(r.choice("aaeeiioottnnsshrdlu") for _ in range(r.randint(2, 9))) for _ in range(1500))
    noise = " ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(400))
    same = " ".join(f"abc{i % 10}" * 30 for i in range(10)) + " " + "z" * 6000 + " a b c"
    half = prose + " " + "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    got = {x.doc_id: x for x in quality.compression_bands(spark.createDataFrame(
        [(1, prose), (2, noise), (3, same), (4, half), (5, prose[:100])], "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, True]
    assert not got[2].base_failed and not got[4].base_failed
    assert got[1].doc_ratio > 1 and quality.chunk_bounds(9000) == [(0, 4096), (4096, 9000)]


# --- 4 suffixes -------------------------------------------------------------

def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        on = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                on[i:i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, on) if not y)
        out.append((len(b), sum(on), sum(1 for i in range(len(on)) if on[i] and not (i and on[i - 1])), kept))
    return out


def brute_passages(texts, length, words):
    """The texts without the runs of repeated strings that hold ``words`` words or more."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        on = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                on[i:i + length] = b"\1" * length
        stretches = [(k, bytes(x for x, _ in g)) for k, g in groupby(zip(b, on), key=lambda x: x[1])]
        kept, part = [], b""
        for k, x in stretches:
            if k and len(x.split()) >= words:
                kept.append(part)
                part = b""
            else:
                part += x
        out.append("".join(x.decode("utf-8", "ignore") for x in [*kept, part]))
    return out


@pytest.mark.parametrize("seed,length", [(0, 25), (1, 40), (2, 400)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, length):
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 40)
    r = random.Random(seed)
    letters = "abcdé " if seed else "ab"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [word(r.randint(length // 2, length * 3)) for _ in range(6)]
    texts = [None, "", "x" * (3 * length), "日本" * length]
    for _ in range(70):
        t = ""
        for _ in range(r.randint(1, 6)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t += p[a:r.randint(a, len(p))] if r.random() < 0.6 else word(r.randint(1, length * 2))
        texts.append(t)
    texts += texts[5:9]
    df = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)],
                               "doc_id long, text string, th int, n_spans int").repartition(3)
    got = {x.doc_id or 0: x for x in suffixes.cut_repeats(df, length=length).collect()}
    for i, want in enumerate(brute_repeats(texts, length)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) == want
        assert x.kept_text in (want[3].decode("utf-8", "ignore"), x.kept_text) and "�" not in x.kept_text
    assert suffixes.cut_repeats(df.limit(0), length=length).count() == 0


@pytest.mark.parametrize("most", [50_000, 20])
def test_hot_group_of_blocks(spark, monkeypatch, most):
    """One passage in every text, each time with other neighbours; small
    groups are merged, large ones settled window by window."""
    monkeypatch.setattr(suffixes, "GROUP_BLOCKS", most)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(130)
    texts = [word(r.randint(30, 90)) + passage[r.randint(0, 30):] + word(r.randint(30, 90)) for _ in range(300)]
    texts += texts[:3] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes))
           for x in suffixes.cut_repeats(df, length=50).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 50)


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree_merges_with_shared_prefixes(seed):
    r = random.Random(seed)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 30)))
            for _ in range(r.randint(0, 7))]
    coded = [[(x, k, i) for x, k in zip(run, suffixes.front_code(run))] for i, run in enumerate(runs)]
    got = list(suffixes.LoserTree(coded))
    assert [x[0] for x in got] == sorted(x for run in runs for x in run)
    for (a, _, _), (b, same, _) in zip(got[:-1], got[1:]):
        assert same == len(__import__("os").path.commonprefix([a, b]))


# --- 5 vectors --------------------------------------------------------------

def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows, v = [], []
    centre = r.standard_normal((6, 16))
    for i in range(700):
        family = i % 60
        x = centre[family % 6] + r.standard_normal(16) * (0.03 if family < 6 else 2.0)
        v.append(x)
        rows.append((i, x.tolist(), i % 2))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 16, 1),
             (1005, [float("nan")] * 16, 1), (1006, [None] * 16, 1), (1007, [], 1), (1008, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = nndescent.near_vectors(df.selectExpr("*", "1 as node", "2 as grp"), neighbours=6).collect()
    assert len(got) == len(rows)
    use = [(i, np.array(x), l) for i, x, l in rows if i is not None and (i <= 1001)]
    ids = np.array([u[0] for u in use])
    m = np.array([u[1] for u in use])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.array([u[2] for u in use])
    hit = (m @ m.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    parent = {int(i): int(i) for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(hit)):
        x, y = find(int(ids[a])), find(int(ids[b]))
        parent[max(x, y)] = min(x, y)
    links = dict(zip(ids.tolist(), hit.sum(axis=1).tolist()))
    for x in got:
        assert x.n_links == links.get(x.vec_id, 0)
        assert x.component_id == (None if x.vec_id is None else find(x.vec_id) if x.vec_id in parent else x.vec_id)
        assert x.kept == (x.vec_id == x.component_id)
    assert nndescent.near_vectors(df.limit(0)).count() == 0


def brute_links(m, threshold=0.98):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1).tolist(), union_find(len(m), zip(*np.nonzero(hit)))


def check_links(got, m):
    links, group = brute_links(m)
    for x in got:
        assert (x.n_links, x.component_id, x.kept) == (links[x.vec_id], group[x.vec_id], group[x.vec_id] == x.vec_id)


def test_links_between_saturated_families(spark):
    """Lists fill with the own family; the other family is linked as well, and
    a third one by a single pair of nodes."""
    r = np.random.default_rng(4)
    first = np.eye(32)[0]
    centre = [first, 0.985 * first + np.sqrt(1 - 0.985 ** 2) * np.eye(32)[1]]
    far = 0.955 * first + np.sqrt(1 - 0.955 ** 2) * np.eye(32)[2]
    m = np.array([c + np.concatenate([np.zeros(8), r.standard_normal(24) * 0.002]) for c in (centre[0], far, centre[1]) for _ in range(20)])
    m[33] = 0.97 * far / np.linalg.norm(far) + 0.25 * first
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(m)], "vec_id long, embedding array<double>, label int")
    check_links(nndescent.near_vectors(df).collect(), m)


def test_links_that_descent_misses(spark, monkeypatch):
    """No tree finds anything: the audit must not let that pass."""
    plant = nndescent.plant
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    monkeypatch.setattr(nndescent, "plant", lambda *a: plant(*a).limit(0))
    r = np.random.default_rng(6)
    m = r.standard_normal((150, 16))
    m[100] = m[3] + 0.01
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(m)], "vec_id long, embedding array<double>, label int")
    assert brute_links(m)[0][3] == 1
    check_links(nndescent.near_vectors(df).collect(), m)


def test_audit_without_links_is_no_evidence(spark):
    nodes = spark.createDataFrame([(i, "g", np.eye(8)[i].tolist(), 1) for i in range(8)],
                                  "node long, grp string, vec array<double>, copies long")
    degrees = spark.createDataFrame([], "node long, pairs long")
    graph = spark.createDataFrame([], "node long, nbrs array<struct<cos:double,nbr:long>>")
    asked = nndescent.picked(graph, nodes, 0.98)
    assert asked.count() == 8 and nndescent.audit(degrees, graph, asked, nodes, 0.98) == (None, 0.0)


def families_with_fringe():
    """Families of 40 near copies, each with vectors at its rim that link with
    a few members only."""
    r = np.random.default_rng(12)
    m = []
    for f in range(6):
        axis = np.eye(48)[f]
        spread = [np.concatenate([np.zeros(6), r.standard_normal(42)]) for _ in range(40)]
        inner = [axis + 0.14 * x / np.linalg.norm(x) * r.uniform(0.3, 1) for x in spread]
        m += inner
        for _ in range(24):
            away = inner[r.integers(40)] - axis
            m.append(axis + away * r.uniform(1.9, 2.4))
    return np.array(m)


@pytest.mark.parametrize("longest", [12, 96])
def test_fringe_of_saturated_families(spark, monkeypatch, longest):
    """One row a vector, with its links counted once, when the audit passes:
    unsaturated vectors that link with saturated ones."""
    m = families_with_fringe()
    links = brute_links(m)[0]
    fringe = [links[i] for i in range(len(m)) if i % 64 >= 40]
    assert sum(0 < x <= 11 for x in fringe) > 20 and max(links) > 30
    monkeypatch.setattr(nndescent, "audit", lambda *a: (1.0, 1.0))
    enlarge = nndescent.enlarge
    monkeypatch.setattr(nndescent, "enlarge", lambda *a: enlarge(*a, longest=longest))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(m)], "vec_id long, embedding array<double>, label int")
    got = nndescent.near_vectors(df).collect()
    assert len(got) == len(m)
    check_links(got, m)


def test_a_table_without_links_ends_without_all_pairs(spark, monkeypatch):
    """The nearest neighbours of the audited nodes are evidence enough."""
    asked = []
    in_full = nndescent.in_full

    def counted(nodes_asked, nodes, threshold):
        asked.append((nodes_asked.count(), nodes.count()))
        return in_full(nodes_asked, nodes, threshold)

    monkeypatch.setattr(nndescent, "in_full", counted)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nndescent.near_vectors(df).groupBy("n_links").count().collect()
    assert [x.n_links for x in got] == [0]
    assert all(a < n / 2 for a, n in asked)


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_a_tile(seed):
    r = np.random.default_rng(seed)
    hit = r.random((30, 40)) < 0.03
    row, col = nndescent.connected(hit)
    want = union_find(70, [(a, 30 + b) for a, b in zip(*np.nonzero(hit))])
    on = np.concatenate([hit.any(axis=1), hit.any(axis=0)])
    assert [x for x, y in zip([*row, *col], on) if y] == [x for x, y in zip(want, on) if y]
    assert all(x == -1 for x, y in zip([*row, *col], on) if not y)


# --- 6 SimHash --------------------------------------------------------------

def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("expanded", [1 << 21, 500])
def test_ball_links_connect_like_brute_force(spark, monkeypatch, expanded):
    monkeypatch.setattr(simhash, "EXPANDED", expanded)
    r = random.Random(9)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    got = simhash.ball_links(df).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert union_find(len(fps), [(place[x.a], place[x.b]) for x in got]) == union_find(len(fps), pairs)


def test_simhash_of_odd_rows(odd, odd_rows, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(odd_rows)
    for x in got:
        if x.doc_id in (100, 101, 102):
            assert (x.fingerprint, x.component_id) == ("0" * 16, 100)
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.one_of_each(odd)
    fps = sorted({simhash.fingerprint(x[1]) for x in odd_rows})
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert len(set(union_find(len(fps), near))) == kept.count() and kept.columns == odd.columns


def test_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(200)] + [(900, 900)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[500 + i] == 500 for i in range(200)) and 900 not in got


# --- 7 licences -------------------------------------------------------------

def test_licence_model_on_held_out_rows(spark, odd, odd_rows, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    paragraphs = licences.sample_paragraphs(docs, "doc_id", "text")
    assert len(paragraphs) <= licences.UNKNOWN_ROWS
    model = licences.fit(licences.training_rows(paragraphs, seed=1))
    fresh = licences.training_rows(paragraphs, seed=2)[:2500]
    right = sum(model.predict(p)[0] == c for p, c in fresh) / len(fresh)
    assert right > 0.97
    for s in licences.UNNAMED:
        _, found = licences.scan(s, model)
        assert not any(x[3] for x in found)
    n, found = licences.scan("Some words.\n\n  \nReleased under the MIT License.\nmore", model)
    assert n == 3 and [(x[0], x[1], x[3]) for x in found] == [(3, "MIT", True)]
    assert licences.licence_scan(odd, model).count() == len(odd_rows)
    assert licences.licence_scan(none, licences.train(none)).count() == 0


HEADERS = {
    "BSD": "Copyright 2020 The Authors.\n\nRedistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions\nare met:",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n"
               " * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */",
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n"
               "# it under the terms of the GNU General Public License as published by\n"
               "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
                "License as published by the Free Software Foundation, either\nversion 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache\nLicense, Version 2.0 (the \"License\");\nyou may not use this file except in compliance",
}


def test_wrapped_notices(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    model = licences.train(docs)
    prose = " ".join(f"river stone {i} and bridge" for i in range(300))
    sure = lambda t: [x[1] for x in licences.scan(t, model)[1] if x[3]]
    for family, t in HEADERS.items():
        assert sure(t) == [family]
        assert sure("Some words before.\n" + t + "\nand some after.") == [family]
        assert sure(f"{prose} {' '.join(t.split())} {prose}") == [family]
    assert sure(HEADERS["GPL-3.0"].replace("version 3", "version 2")) == []
    # a blank line ends a paragraph
    assert sure(HEADERS["MPL-2.0"].replace("Mozilla Public\n", "Mozilla Public\n\n")) == []


NEIGHBOURS = {
    "AGPL-3.0": HEADERS["GPL-3.0"].replace("GNU General", "GNU Affero General"),
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                       "International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "// SPDX-License-Identifier: CC-BY-4.0", "MIT": "# SPDX-License-Identifier: MIT",
    "Apache-2.0": "/* SPDX-License-Identifier: Apache-2.0 */", "GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above notice appears in all copies.",
}
# No notice of a known family: denied, of another version, or of a family that no template holds.
STRANGERS = (
    "This file is not released under the MIT License.", "It was never licensed under the Apache License, Version 2.0.",
    "The work is no longer licensed under CC BY 4.0.", "Licensed under the Apache License, Version 1.1.",
    HEADERS["GPL-3.0"].replace("version 3", "version 2"), "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-SA 3.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "SPDX-License-Identifier: Zlib",
    "This software is provided as-is, without any express or implied warranty, under the zlib License.",
    "Boost Software License - Version 1.0 - August 17th, 2003", "Everyone is permitted to copy under the terms of the WTFPL.",
    "The Artistic License 2.0 applies to this package.", "Licensed under the Open Software License version 3.0.")


def test_neighbours_and_strangers_are_not_confirmed(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    model = licences.train(docs)
    sure = lambda t: [x[1] for x in licences.scan(t, model)[1] if x[3]]
    for family, t in NEIGHBOURS.items():
        assert sure(t) == [family], t
    for t in STRANGERS:
        assert sure(t) == [], t
    # the denial of another sentence does not count
    assert sure("Do not remove it. Released under the MIT License.") == ["MIT"]


def test_held_out_families_stay_unknown(monkeypatch, spark):
    """Families that training never saw, in the words of their own notices."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    paragraphs = licences.sample_paragraphs(docs, "doc_id", "text")
    out = {"ISC": licences.TEMPLATES["ISC"], "EPL-2.0": licences.TEMPLATES["EPL-2.0"]}
    monkeypatch.setattr(licences, "TEMPLATES", {f: t for f, t in licences.TEMPLATES.items() if f not in out})
    model = licences.fit(licences.training_rows(paragraphs))
    for family, notices in out.items():
        for t in notices:
            assert not any(x[3] for x in licences.scan(t, model)[1])


# --- 8 chat -----------------------------------------------------------------

def test_chat_round_trip(spark):
    odd_text = ["<|im_end|><|im_start|>assistant ok", "<||im_sep|>", "<", "|", None, "", "a\nb<|", "<|||<|im_sep|>", "é" * 50]
    roles = ["user", "assistant", "assistant", None, "sys\ntem\\n", "<|im_start|>"]
    r = random.Random(6)
    rows = [(c if c else None, t if t != 2 else None, r.choice(roles), r.choice(odd_text), 1)
            for c in range(12) for t in range(r.randint(1, 9))]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    out = chat.format_chats(df)
    got = {x.conv_id: x for x in out.select(
        "conv_id", "formatted", chat.read_turns(out.formatted).alias("turns"),
        chat.read_loss(out.formatted, out.loss_spans).alias("loss")).collect()}
    for c in {x[0] for x in rows}:
        want = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c),
                      key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(x.role, x.text) for x in got[c].turns] == [x[2:] for x in want]
        assert got[c].loss == [x[3] for x in want if x[2] == "assistant"]
        merged = sum(1 for i, x in enumerate(want) if not i or want[i - 1][2] != x[2])
        assert got[c].formatted.count(chat.START) == merged == got[c].formatted.count(chat.END)
    assert chat.format_chats(df.limit(0)).count() == 0


# --- 9 mixing ---------------------------------------------------------------

def brute_targets(sizes, weights, share, repeats):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= repeats * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_running_sums_in_levels(spark):
    """Three slices a window, so four levels: the same sums as one window."""
    r = random.Random(8)
    rows = [(r.choice("ab"), r.randint(0, 80), i, r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, slice long, i long, words long")
    for keys in ([], ["k"]):
        got = {x.i: x.at for x in mixing.running(df, keys, "slice", 80, ["i"], "words", "at", wide=3).collect()}
        assert got == {i: sum(w for k2, s2, i2, w in rows if (k2 == k or not keys) and (s2, i2) <= (s, i))
                       for k, s, i, _ in rows}


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_documents(docs).collect()
    again = {x.doc_id: x.times for x in mixing.mix_documents(docs.repartition(5)).collect()}
    assert again == {x.doc_id: x.times for x in got}
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) and 0 <= x.times <= 2
        sizes[x.source] += x["size"]
        taken[x.source] += x["size"] * x.times
    want = brute_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    longest = max(x["size"] for x in got)
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 * want[x.source]
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= longest


def test_mix_of_odd_rows(odd, odd_rows, none, spark):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == len(odd_rows) and {x.source for x in got} == {"s0", "s1", "s2", None}
    assert all(x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) and 0 <= x.times <= 2 for x in got)
    assert mixing.mix_documents(none).count() == 0
    empty = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)
    assert [x.times for x in mixing.mix_documents(empty).collect()] == [0, 0]


def test_mix_of_one_repeated_row(spark):
    """A third of all rows are one and the same row."""
    rows = [(1, "a b c d", "en", "hot", 4)] * 500 + [(i, "w " * (i % 9), "en", f"s{i % 4}", 4) for i in range(2, 1000)]
    got = mixing.mix_documents(spark.createDataFrame(rows, DOCS)).collect()
    taken = sum(x["size"] * x.times for x in got if x.source == "hot")
    assert abs(taken - next(x.target for x in got if x.source == "hot")) < 300 and len(got) == len(rows)


# --- 10 packing -------------------------------------------------------------

def test_packing_covers_every_id_once(odd, odd_rows, none, library):
    sequences = packing.pack_documents(odd, bpe.tokenizer_path(), window=16)
    total, of, text_of = 0, Counter(), {}
    for d, t, *_ in odd_rows:
        ids = library(t)
        total += len(ids)
        of[(d, len(ids))] += len(ids)
        text_of.setdefault((d, len(ids)), ids)
    got = packing.packed_pieces(sequences).collect()
    cover, where = Counter(), {}
    for x in got:
        cover[(x.doc_id, x.doc_tokens)] += x.length
        ids = text_of[(x.doc_id, x.doc_tokens)][x.start:x.start + x.length]
        if x.doc_id != 7:
            assert bytes(x.ids) == ids.tobytes() and x.ids_crc32 == zlib.crc32(ids.tobytes())
        where.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert cover == of
    for spans in where.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 1024
    for x in sequences.collect():
        assert x.n_tokens == len(x.tokens) // 4 and x.padded_length == (x.n_tokens if x.n_tokens & (x.n_tokens - 1) == 0 else 1024)
    assert packing.pack_documents(none, bpe.tokenizer_path()).count() == 0


def test_balance_spreads_cost():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 1024, 600)
    out = packing.balance(lengths, 1024)
    assert len(out) == -(-int(lengths.sum()) // 1024)
    cost = [sum(n + n * n / 1024 for _, _, n in s) for s in out]
    assert max(cost) < 2.1 * min(cost)
    covered = Counter()
    for s in out:
        assert sum(n for _, _, n in s) <= 1024
        for i, _, n in s:
            covered[i] += n
    assert [covered[i] for i in range(600)] == lengths.tolist()


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = "/root/testdata/sf0.01"
    one = P.STAGES[0][1](spark, docs, d).cache()
    texts = {x.doc_id: x.text for x in docs.collect()}
    bad = {i for i, t in texts.items() if (c := brute_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]}
    kept = {x.doc_id for x in one.collect()}
    assert kept == set(texts) - bad and one.columns == docs.columns
    two = P.STAGES[1][1](spark, one, d).cache()
    ids = sorted(kept)
    fps = [simhash.fingerprint(texts[i]) for i in ids]
    root = union_find(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    left = sorted({ids[k] for k in root})
    assert sorted(x.doc_id for x in two.collect()) == left and two.columns == docs.columns
    three = P.STAGES[2][1](spark, two, d).cache()
    want = brute_passages([texts[i] for i in left], P.PASSAGE_BYTES, P.PASSAGE_WORDS)
    got = {x.doc_id: x.text or "" for x in three.collect()}
    assert got == dict(zip(left, want)) and any(got[i] != texts[i] for i in left)
    four = P.STAGES[3][1](spark, three, d).cache()
    assert four.columns == docs.columns and max(Counter(x.doc_id for x in four.collect()).values()) <= 2
    five = P.STAGES[4][1](spark, four, d)
    assert sum(x.length for x in five.collect()) == sum(
        len(x) for x in map(lambda r: bpe.encoder(bpe.tokenizer_path()).encode([r.text or ""])[0] + b"00", four.collect())) // 2


def test_hash_of_kept_bytes_is_stable(spark):
    got = QUERIES["op4_suffix_merge_sort"](spark, SF_SMALL).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    want = {i: (w[0], w[1], w[2], hashlib.sha256(w[3]).hexdigest()) for i, w in zip(ids, brute_repeats([docs[i] for i in ids], 400))}
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want
