"""Secret scans: password guess-cost dynamic programming (operator 13).

Patterns with a fixed form (assignments, access keys, hex runs) are taken as
they stand. Beyond them, the values of credential contexts (``pwd = ...``,
``passphrase is "..."``, ``--token ...``, ``scheme://user:...@host``, ``Bearer
...``) are judged by what it costs to guess them: the cheapest segmentation
into

* words: rank in the corpus's own dictionary (the ``WORDS`` most frequent of
  all documents, behind a short fixed list), with capitals and look-alike
  characters at a surcharge;
* dates of four to ten characters;
* repeats of a unit of up to ``UNIT`` characters: the unit's own cost and the
  number of repeats;
* keyboard walks of three keys or more: start, length and turns;
* brute-force spans: each character by the size of its class.

Every segment costs ``SEGMENT`` besides. The minimum over all segmentations
is found left to right; a brute-force span is a state of its own, so work
grows with the length of the value. Values of ``COST`` (log10 of the guesses)
or more are secrets (kind ``guess``), whatever their length; ``changeme``,
``12345678`` or ``xxxxxxxx`` are not.

Defined results: null text is empty; empty text has no span; every row has a
result of its own, repeated rows equal ones; an empty table gives no rows;
extra columns pass through, input columns with the name of a result are
replaced. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import forget
from .common import put

WORDS = 20_000
WORD_BYTES = 24
UNIT = 16
COST = 9.0
#: A new segment is one of ten kinds and places (log10).
SEGMENT = 1.0
#: Words that a worker counts before it sends them on.
HELD = 400_000
#: Parts of the dictionary that are ranked on their own before all are.
LANES = 16

KINDS = ["assign", "access", "hex", "guess"]

# Fixed values of the base patterns.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

_NAME = rb"(?:pass(?:word|wd|phrase|code)?|pwd|(?<![a-z])pin|secret|token|(?:api|access|private|secret|auth)[ _-]?key|credentials?|login)"
_QUOTED = rb"""(?:"([^"\n]+)"|'([^'\n]+)')"""
_VALUE = rb"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))"""
#: What stands before a value, and the value.
_CONTEXTS = [
    re.compile(rb"(?i)" + _NAME + rb"""["']?[ \t]*(?::=|=>|[:=])[ \t]*""" + _VALUE),
    re.compile(rb"(?i)" + _NAME + rb"[ \t]+is[ \t]+" + _QUOTED),
    re.compile(rb"(?i)(?<!\S)--?" + _NAME + rb"[ \t]+" + _VALUE),
    re.compile(rb"(?i)\bbearer[ \t]+" + _VALUE),
    re.compile(rb"[a-z][a-z0-9+.-]*://[^\s:/@]*:()()([^\s/@]+)@"),
]
#: One of these stands in every context; most texts have none.
_HINTS = [b"pass", b"pwd", b"pin", b"secret", b"token", b"key", b"credential", b"login", b"bearer", b"://"]
_HEX_RUN = bytes(49 if b in b"0123456789abcdef" else 48 for b in range(256))

# Frequent passwords and words of templates: fixed values.
COMMON = """password passwd admin root user login secret token welcome letmein master default changeme example test
guest public private key api access your here enter none null true false insert placeholder dragon monkey shadow
sunshine princess football baseball superman iloveyou trustno qwerty""".split()

# Rows of a keyboard and of the alphabet: fixed values.
_ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_SHIFTED = dict(zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./"))
_KEY = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
_LOOKS = {"4": "a", "@": "a", "3": "e", "1": "l", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
_KEYS, _DEGREE = 47, 4.6

_DATES = [re.compile(p) for p in (
    r"(?P<y>(?:19|20)\d\d)([-/._]?)(?P<m>0[1-9]|1[0-2])\2(?P<d>0[1-9]|[12]\d|3[01])",
    r"(?P<d>0[1-9]|[12]\d|3[01])([-/._]?)(?P<m>0[1-9]|1[0-2])\2(?P<y>(?:19|20)\d\d)",
    r"(?P<m>0[1-9]|1[0-2])([-/._]?)(?P<d>0[1-9]|[12]\d|3[01])\2(?P<y>(?:19|20)\d\d)",
    r"(?P<y>(?:19|20)\d\d)")]


def _step(a: str, b: str):
    """The direction from one key to a neighbour, or None."""
    if a.isalpha() and b.isalpha() and ord(b) - ord(a) in (1, -1):
        return "alphabet", ord(b) - ord(a)
    p, q = _KEY.get(a), _KEY.get(b)
    if p is None or q is None or p == q:
        return None
    d = q[0] - p[0], q[1] - p[1]
    # rows are shifted: a key touches the one below and the one to its left there
    return d if d in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) else None


def _char(c: str) -> float:
    if c.isdigit() and c.isascii():
        return 1.0
    if c.isascii():
        return math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def _capitals(word: str) -> float:
    up = sum(c.isupper() for c in word)
    low = len(word) - up
    if not up:
        return 0.0
    if not low or (up == 1 and (word[0].isupper() or word[-1].isupper())):
        return math.log10(2)
    return math.log10(sum(math.comb(up + low, i) for i in range(1, min(up, low) + 1)))


def segments(value: str, ranks: dict[str, int], repeats: bool = True):
    """All segments that are cheaper to name than to try: start, stop, kind, cost."""
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a capital whose small form is longer stays as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = "".join(_LOOKS.get(c, c) for c in low)
    look = [0, *map(int.__add__, *([0] * n, [a != b for a, b in zip(low, plain)]))]
    for i in range(1, n + 1):
        look[i] += look[i - 1]
    longest = max(map(len, ranks), default=0)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for word, extra in ((low[i:j], 0), (plain[i:j], look[j] - look[i])):
                rank = ranks.get(word)
                if rank is not None:
                    yield i, j, "word", math.log10(rank + 1) + _capitals(value[i:j]) + extra * math.log10(2)
                if not look[j] - look[i]:
                    break
        for p in _DATES:
            m = p.match(value, i)
            if m:
                years = max(abs(int(m["y"]) - 2000), 20)
                days = 365 if "m" in p.groupindex else 1
                sep = math.log10(4) if days > 1 and m[2] else 0.0
                yield i, m.end(), "date", math.log10(years * days) + sep
    # a walk ends where the next key is no neighbour; a turn is a change of direction
    keys = "".join(_SHIFTED.get(c, c) for c in low)
    step = [_step(a, b) for a, b in zip(keys[:-1], keys[1:])]
    end, turns = n, 1
    for i in range(n - 2, -1, -1):
        if step[i] is None:
            end, turns = i + 1, 1
            continue
        if i + 1 >= n - 1 or step[i + 1] is None:
            end, turns = i + 2, 1
            while end < n and step[end - 1] is not None:
                end += 1
        elif step[i] != step[i + 1]:
            turns += 1
        if end - i >= 3:
            yield i, end, "walk", math.log10(_KEYS) + turns * math.log10(_DEGREE) + math.log10(end - i)
    if not repeats:
        return
    known: dict[str, float] = {}
    for u in range(1, min(UNIT, n // 2) + 1):
        run = 0
        for i in range(n - u - 1, -1, -1):
            run = run + 1 if value[i] == value[i + u] else 0
            if run >= u and (u > 1 or run >= 2):
                unit, times = value[i:i + u], run // u + 1
                if unit not in known:
                    known[unit] = guess_cost(unit, ranks, repeats=False)[0]
                yield i, i + u * times, "repeat", known[unit] + math.log10(times)


def guess_cost(value: str, ranks: dict[str, int], repeats: bool = True):
    """(log10 of the guesses, segments: start, stop, kind) of the cheapest
    segmentation of ``value``."""
    n = len(value)
    by_start: list[list] = [[] for _ in range(n)]
    for i, j, kind, cost in segments(value, ranks, repeats):
        by_start[i].append((j, kind, cost + SEGMENT))
    best, came = [math.inf] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    brute, since = math.inf, 0
    for i in range(n):
        if best[i] + SEGMENT < brute:
            brute, since = best[i] + SEGMENT, i
        brute += _char(value[i])
        if brute < best[i + 1]:
            best[i + 1], came[i + 1] = brute, (since, "brute")
        for j, kind, cost in by_start[i]:
            if best[i] + cost < best[j]:
                best[j], came[j] = best[i] + cost, (i, kind)
    way, at = [], n
    while at:
        start, kind = came[at]
        way.append((start, at, kind))
        at = start
    return best[n], way[::-1]


def ranked(words: list[str]) -> dict[str, int]:
    """Ranks from 1: the fixed words, then the given ones, most frequent first."""
    out: dict[str, int] = {}
    for w in (*COMMON, *words):
        out.setdefault(w, len(out) + 1)
    return out


def scan_text(text: str, ranks: dict[str, int], threshold: float = COST) -> list[tuple]:
    """(kind number, start, stop, cost or None) of every span, in order."""
    raw = text.encode()
    low = raw.lower()
    hint = [h for h in _HINTS if h in low]
    found = []
    if any(h in hint for h in (b"pass", b"secret", b"token", b"key")):
        found += [(0, m.start(), m.end(), None) for m in _ASSIGN.finditer(raw) if len(m[1]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end(), None) for m in _ACCESS.finditer(raw) if len(m[0]) >= ACCESS_CHARS]
    if b"1" * HEX_CHARS in raw.translate(_HEX_RUN):
        found += [(2, m.start(), m.end(), None) for m in _HEX.finditer(raw) if len(m[0]) >= HEX_CHARS]
    if hint:
        values = {m.span(m.lastindex) for p in _CONTEXTS for m in p.finditer(raw)}
        for a, b in sorted(values):
            cost = guess_cost(raw[a:b].decode(), ranks)[0]
            if cost >= threshold:
                found.append((3, a, b, cost))
    found.sort(key=lambda x: (x[1], x[0], x[2]))
    if found and not raw.isascii():
        at = sorted({p for x in found for p in x[1:3]})
        chars, place, before = {}, 0, 0
        for p in at:
            place += len(raw[before:p].decode())
            chars[p], before = place, p
        found = [(k, chars[a], chars[b], c) for k, a, b, c in found]
    return found


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[str]:
    """The ``words`` most frequent words of all whole texts (letters only,
    lower-cased A-Z, 3 characters or more, up to ``WORD_BYTES`` bytes; equal
    counts by the word). Bounded by its parameter."""
    table = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def counted(batches):
        forget()
        held: Counter = Counter()

        def rows():
            some = [(w.decode(), n) for w, n in held.items() if 3 <= len(w) <= WORD_BYTES]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()),
                                               pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if t:
                    held.update(t.translate(table).split())
                    if len(held) > HELD:
                        yield rows()
        yield rows()

    counts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(counted, "word string, n long")
    counts = counts.where(F.length("word") >= 3).groupBy("word").agg(F.sum("n").alias("n"))
    # the best of each lane first, so that what reaches the driver is bounded
    # by lanes and words, whatever the number of tasks
    most = [F.col("n").desc(), F.col("word")]
    lane = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(LANES))).orderBy(*most)
    best = counts.withColumn("place", F.row_number().over(lane)).where(F.col("place") <= words)
    return [r["word"] for r in best.select("word", "n").orderBy(*most).limit(words).collect()]


def find_secrets(docs: DataFrame, words: list[str], text_col: str = "text", threshold: float = COST) -> DataFrame:
    """``docs`` with ``findings`` (kind, start, stop, cost of a guess), counts
    by kind, ``base_sha256`` over the spans of the fixed patterns and
    ``spans`` (all, as text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked(words))

    @F.pandas_udf("array<struct<kind:int,start:long,stop:long,cost:double>>")
    def scan(texts: pd.Series) -> pd.Series:
        forget()
        ranks = shared.value
        return pd.Series([[dict(zip(("kind", "start", "stop", "cost"), x)) for x in scan_text(t, ranks, threshold)]
                          if t else [] for t in texts])

    names = F.array(*map(F.lit, KINDS))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("__found", lambda x: x["kind"] == k)).cast("long")
    rows = docs.select("*", scan.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("__found"))
    return put(rows, findings=F.transform("__found", lambda x: F.struct(
        F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["cost"].alias("cost"))),
        **{f"n_{name}": of(k) for k, name in enumerate(KINDS)},
        base_sha256=F.sha2(told(F.filter("__found", lambda x: x["kind"] < 3)), 256), spans=told(F.col("__found"))).drop("__found")
