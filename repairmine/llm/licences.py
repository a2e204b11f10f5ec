"""License scans: a trained paragraph classifier (operator 7).

A paragraph is counted for each line that holds a word. Lines are classified
one by one; notices that run over several lines, or stand in a long one, are
found in the lines joined up to a blank one: a window slides over the word
pairs of every template, and what holds enough of them is classified as a
whole. Unconfirmed finds of the same family inside it are parts of it. Features are the word
unigrams and bigrams of the lower-cased paragraph that the training rows hold
at least twice. A multinomial logistic regression (one class a licence
family, one class unknown) is trained on a bounded sample: notices of the
families in random contexts, sentences about licences that name no family, and
at most ``UNKNOWN_ROWS`` paragraphs of the corpus itself (those that hold a
notice are labelled with its family). A held-out quarter calibrates it: a
temperature for the probabilities, and the least probability that keeps
unknown paragraphs out. A predicted family is confirmed by its templates: one
of the family's notices must have ``CONFIRM`` of its word pairs in a window
of the paragraph, among them all that hold a number (the version); window and
notice must hold the same deciding words (``DECIDING``: Affero, Lesser,
NonCommercial and the like), and no negation may stand in the window, or up
to four words before it in its sentence, that the notice does not hold.

The sample's bounds are parameters; scoring covers every paragraph of every
document, map-side, with the model (at most ``FEATURES`` rows) in the closure.

Defined results: null, empty and blank texts have no paragraphs; equal rows
are scored alike; an empty table gives no rows (the model then has notices
only); extra columns are ignored. Paragraphs without any feature are unknown.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

# The usual short notices of licence families.
TEMPLATES = {
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",
                 "GNU Affero General Public License Version 3, 19 November 2007",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
                   "This project is released under the Apache 2.0 license.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    "BSD": ("Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons "
                        "Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"),
    "EPL-2.0": ("Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made "
                "available under the terms of the Eclipse Public License 2.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "GNU General Public License Version 3, 29 June 2007", "Released under the GPL version 3 or later.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for "
            "any purpose with or without fee is hereby granted."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",
                 "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
# A file's licence identifier is a notice too.
TEMPLATES = {family: (*notices, *(f"SPDX-License-Identifier: {i}" for i in (
    ("BSD-2-Clause", "BSD-3-Clause") if family == "BSD" else (family,)))) for family, notices in TEMPLATES.items()}
# Words that tell a family from its neighbours, and negations.
DECIDING = {"affero", "agpl", "lesser", "lgpl", "noncommercial", "nc", "sharealike", "sa", "noderivatives",
            "noderivs", "nd"}
NEGATIONS = {"not", "never", "no", "nor", "neither", "cannot", "isn", "aren", "wasn", "weren", "without"}
LOOK_BACK = 4
# Sentences about licences that name no family.
UNNAMED = (
    "All rights reserved.", "A valid license key is required to run this software.", "See the license file for details.",
    "Their driving license had expired in January.", "The work is under review and will be released in version 2.",
    "The general public was permitted to use the source.", "He is licensed to practise medicine.",
    "The license fee is due with or without notice.", "This project was released under great pressure.",
    "A software version for public use was released.", "Permission is granted to members of the public library.",
    "International attribution of the work remains unclear.")
UNKNOWN = "unknown"
UNKNOWN_ROWS = 4000
SAMPLE_CHARS = 2000
NOTICE_ROWS = 150
FEATURES = 1 << 13
CONFIRM = 0.8
LEAKED = 0.001
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_STOP = re.compile(r"[^\W_]+|[.!?](?=\s|$)")


def features(paragraph: str) -> list[str]:
    w = _WORD.findall(paragraph.lower())
    return [*dict.fromkeys(w), *dict.fromkeys(map(" ".join, zip(w, w[1:])))]


def _pairs(text: str) -> set[tuple[str, str]]:
    w = _WORD.findall(text.lower())
    return set(zip(w, w[1:]))


def _numbered(pair: tuple[str, str]) -> bool:
    return pair[0].isdigit() or pair[1].isdigit()


#: Templates by word pair, and of each: family, pairs, numbered pairs, longest span in words, words.
_KNOWN = [(f, _pairs(t), {p for p in _pairs(t) if _numbered(p)}, 2 * len(_WORD.findall(t)) + 8, set(_WORD.findall(t.lower())))
          for f, ts in TEMPLATES.items() for t in ts]
_OF: dict[tuple[str, str], list[int]] = {}
for _i, _t in enumerate(_KNOWN):
    for _p in _t[1]:
        _OF.setdefault(_p, []).append(_i)


def words_of(line: str) -> tuple[list[str], set[int]]:
    """The words of a line, and the numbers of those that begin a sentence."""
    words, starts = [], set()
    for x in _WORD_OR_STOP.findall(line.lower()):
        if x in ".!?":
            starts.add(len(words))
        else:
            words.append(x)
    return words, starts


def decided(own: set[str], words: list[str], starts: set[int], a: int, b: int) -> bool:
    """Whether words ``a`` to ``b`` mean the notice with the words ``own``, not a neighbour or its denial."""
    window = set(words[a:b + 1])
    if window & DECIDING != own & DECIDING or window & NEGATIONS - own:
        return False
    for j in range(a, max(a - LOOK_BACK, 0), -1):
        if j in starts:
            break
        if words[j - 1] in NEGATIONS:
            return False
    return True


def spans(words: list[str], starts: set[int]) -> list[tuple[str, int, int]]:
    """(family, first word, last word) wherever a window holds ``CONFIRM`` of a template and is ``decided``."""
    hits: dict[int, list[int]] = {}
    pairs = list(zip(words, words[1:]))
    for i, p in enumerate(pairs):
        for k in _OF.get(p, ()):
            hits.setdefault(k, []).append(i)
    out = []
    for k, at in hits.items():
        family, own, numbered, reach, vocabulary = _KNOWN[k]
        if len(at) < CONFIRM * len(own):
            continue
        seen: dict[tuple[str, str], int] = {}
        first = 0
        for j, i in enumerate(at):
            seen[pairs[i]] = seen.get(pairs[i], 0) + 1
            while i - at[first] > reach or seen[pairs[at[first]]] > 1:
                p = pairs[at[first]]
                seen[p] -= 1
                if not seen[p]:
                    del seen[p]
                first += 1
            if (len(seen) >= CONFIRM * len(own) and numbered <= seen.keys()
                    and decided(vocabulary, words, starts, at[first], i + 1)):
                out.append((family, at[first], i + 1))
                seen, first = {}, j + 1
    return out


def best_template(paragraph: str) -> tuple[str, float]:
    """The family whose notice the paragraph holds, with the share 1, or else
    the one that shares most word pairs, with a share below 1."""
    found = spans(*words_of(paragraph))
    if found:
        return max(found, key=lambda x: x[2] - x[1])[0], 1.0
    own = _pairs(paragraph)
    family, share = max(((k[0], len(k[1] & own) / len(k[1])) for k in _KNOWN), key=lambda x: x[1])
    return family, min(share, 0.99)


def training_rows(paragraphs: list[str], seed: int = 11) -> list[tuple[str, str]]:
    """(paragraph, class): notices in contexts, unnamed sentences, corpus rows."""
    r = random.Random(seed)
    out = []
    for p in paragraphs:
        family, share = best_template(p)
        if share == 1:
            out.append((p, family))
        elif share < 0.5:
            out.append((p, UNKNOWN))
    words = [w for p in paragraphs[:500] for w in p.split()] or ["text"]
    around = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 8)))
    for family, notices in TEMPLATES.items():
        for i in range(NOTICE_ROWS):
            t = notices[i % len(notices)].split()
            if r.random() < 0.3 and len(t) > 6:
                t.pop(r.randrange(len(t)))
            t = " ".join(t)
            out.append((f"{around()} {t.upper() if r.random() < 0.1 else t} {around()}".strip(), family))
    for s in UNNAMED:
        out += [(f"{around()} {s} {around()}".strip(), UNKNOWN) for _ in range(20)]
    # contexts alone, so that none of their words speaks for a family
    out += [(f"{around()} {around()}".strip(), UNKNOWN) for _ in range(NOTICE_ROWS * 4)]
    r.shuffle(out)
    return out


class Model:
    """Weights by feature, bias, temperature and least probability."""

    def __init__(self, classes: list[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.classes, self.vocabulary, self.weights, self.bias = classes, vocabulary, weights, bias
        self.temperature, self.least = 1.0, 0.5

    def logits(self, paragraph: str) -> np.ndarray | None:
        """None where no feature is known: the paragraph is unknown."""
        on = [k for f in features(paragraph) if (k := self.vocabulary.get(f)) is not None]
        return self.bias + self.weights[on].sum(axis=0) if on else None

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        e = np.exp((z - z.max(axis=-1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, paragraph: str) -> tuple[str, float]:
        z = self.logits(paragraph)
        if z is None:
            return UNKNOWN, 1.0
        p = self.probabilities(z)
        k = int(p.argmax())
        if self.classes[k] != UNKNOWN and p[k] < self.least:
            return UNKNOWN, float(p[self.classes.index(UNKNOWN)])
        return self.classes[k], float(p[k])


def fit(rows: list[tuple[str, str]], steps: int = 300, ridge: float = 1e-4) -> Model:
    """Full-batch gradient descent (Adam) on three quarters of the rows, then
    calibration on the rest."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    cut = len(rows) * 3 // 4
    train, rest = rows[:cut], rows[cut:]
    seen: dict[str, int] = {}
    own = [features(p) for p, _ in train]
    for fs in own:
        for f in fs:
            seen[f] = seen.get(f, 0) + 1
    kept = sorted((f for f, n in seen.items() if n > 1), key=lambda f: (-seen[f], f))[:FEATURES]
    vocabulary = {f: i for i, f in enumerate(kept)}
    row = np.array([i for i, fs in enumerate(own) for f in fs if f in vocabulary], dtype=np.int64)
    col = np.array([vocabulary[f] for fs in own for f in fs if f in vocabulary], dtype=np.int64)
    y = np.array([classes.index(c) for _, c in train])
    k, n = len(classes), len(train)
    w, b = np.zeros((len(kept), k)), np.zeros(k)
    m, v = np.zeros((len(kept) + 1, k)), np.zeros((len(kept) + 1, k))
    by_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    by_col = np.argsort(col, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(kept)))])
    add = lambda x, cuts: np.diff(np.concatenate([np.zeros((1, k)), np.cumsum(x, axis=0)])[cuts], axis=0)
    for step in range(1, steps + 1):
        z = add(w[col], by_row) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        g = np.concatenate([add(p[row[by_col]], edges) + ridge * w, p.sum(axis=0, keepdims=True)])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model = Model(classes, vocabulary, w, b)
    scored = [(z, classes.index(c)) for p, c in rest if (z := model.logits(p)) is not None]
    if scored:
        z, truth = np.array([s[0] for s in scored]), np.array([s[1] for s in scored])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(z)[np.arange(len(z)), truth], 1e-12)).mean()

        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
        p = model.probabilities(z)
        wrong = np.sort(p[truth == classes.index(UNKNOWN), :-1].max(axis=1))[::-1]
        allowed = int(LEAKED * len(wrong))
        if len(wrong) > allowed:
            model.least = min(0.95, max(0.5, float(wrong[allowed]) + 1e-9))
    return model


def sample_paragraphs(docs: DataFrame, id_col: str, text_col: str, rows: int = UNKNOWN_ROWS) -> list[str]:
    """At most ``rows`` paragraphs of at most ``SAMPLE_CHARS`` characters, from
    documents picked by a hash of the id: the bounded training sample."""
    n = docs.count()
    share = min(1.0, rows / max(1, n))
    text, key = F.col(f"`{text_col}`"), F.xxhash64(F.lit(5), F.col(f"`{id_col}`").cast("string"))
    lines = (docs.where(F.pmod(key, F.lit(1 << 20)) <= int(share * (1 << 20))).select(key.alias("k"), F.explode(
        F.split(text, "\n")).alias("p")).where((F.length(F.trim("p")) > 0) & (F.length("p") <= SAMPLE_CHARS)))
    picked = lines.orderBy(F.xxhash64("k", "p")).limit(rows).collect()
    return sorted({r["p"] for r in picked})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(training_rows(sample_paragraphs(docs, id_col, text_col)))


def scan(text: str | None, model: Model) -> tuple[int, list[tuple]]:
    """Paragraphs of a text, and its finds: (line, family, probability, confirmed)."""
    n, found, block = 0, [], []
    for i, line in enumerate([*(text or "").split("\n"), ""]):
        if line.strip():
            n += 1
            block.append((i, line))
        elif block:
            found += scan_block(block, model)
            block = []
    return n, found


def scan_block(block: list[tuple[int, str]], model: Model) -> list[tuple]:
    """Finds of lines without a blank one between them."""
    found, words, of, starts = [], [], [], set()
    for i, line in block:
        w, s = words_of(line)
        family, p = model.predict(line)
        if family != UNKNOWN:
            found.append((i, family, p, any(x[0] == family for x in spans(w, s))))
        starts |= {len(words) + k for k in s}
        words += w
        of += [i] * len(w)
    for family, a, b in spans(words, starts):
        inside = [x for x in found if of[a] <= x[0] <= of[b] and x[1] == family]
        if any(x[3] for x in inside):
            continue
        told, p = model.predict(" ".join(words[a:b + 1]))
        if told == family:
            found = [x for x in found if x not in inside] + [(of[a], family, p, True)]
    return sorted(found, key=lambda x: x[0])


def licence_scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_paragraphs`` and ``finds``, an array
    of ``line, family, probability, confirmed``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    find = T.StructType([T.StructField("line", T.LongType()), T.StructField("family", T.StringType()),
                         T.StructField("probability", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_paragraphs", T.LongType()),
                           T.StructField("finds", T.ArrayType(find))])
    arrow = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
                                ("confirmed", pa.bool_())]))

    def scanned(batches):
        for batch in batches:
            for b in pieces(batch, "text", 4 << 20):
                got = [scan(t, model) for t in b.column(1).to_pylist()]
                finds = [[dict(zip(("line", "family", "probability", "confirmed"), x)) for x in f] for _, f in got]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()),
                                                  pa.array(finds, arrow)], names=["doc_id", "n_paragraphs", "finds"])

    return rows.mapInArrow(scanned, schema)
