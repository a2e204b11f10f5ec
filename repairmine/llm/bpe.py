"""Token ids from a public tokenizer file, with a cache of pre-tokens.

The byte-level model splits a text into pre-tokens that are encoded
independently of each other. Corpora repeat them, so each worker keeps a
bounded two-generation cache from pre-token to ids and gives the
``tokenizers`` library only those it has not met, many in one call. Texts holding any
character outside ASCII and Latin-1 letters go to the library whole, as do
those that hold the string of an added token (``<|endoftext|>``, which has an
id of its own) and all texts of a tokenizer with another pre-tokenizer.
"""

from __future__ import annotations

import gc
import json
import re
import zlib

import numpy as np

#: The pre-token pattern of byte-level models, for texts of ``_PLAIN`` only
#: (there the classes of letters, digits and space are these ranges). Fixed values.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_L}]*")
_SPLIT = re.compile(rf" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")

def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies:
    printing ones for themselves, the others for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Entries of one cache generation; two are kept.
GENERATION = 800_000
END_ID = 0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to little-endian unsigned id bytes of ``width`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the library takes these strings out of a text before it splits it
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        pre = spec.get("pre_tokenizer") or {}
        self.split = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                      and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # the same model over a list of pre-tokens, already in its alphabet
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.alphabet = {**byte_alphabet(), 1: "\n"}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words) -> dict[str, bytes]:
        """Ids of pre-tokens that the young generation lacks."""
        got, fresh = {}, []
        for w in words:
            if (b := self.old.get(w)) is not None:
                got[w] = b
            else:
                fresh.append(w)
        for i in range(0, len(fresh), 2000):
            part = fresh[i:i + 2000]
            e = self.words.encode("\x01".join(part).encode().decode("latin-1").translate(self.alphabet),
                                  add_special_tokens=False)
            ids, of = np.array(e.ids, dtype=self.dtype), np.array(e.word_ids)
            cut = np.searchsorted(of, np.arange(len(part) + 1)) * self.dtype.itemsize
            raw = ids.tobytes()
            got.update(zip(part, [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]))
        if len(self.young) + len(got) > GENERATION:
            self.old, self.young = self.young, {}
        if len(got) <= GENERATION:
            self.young.update(got)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text, without an end id. Nothing here makes a
        cycle, so the collector need not walk the lists of a batch."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd, waiting, miss = [], [], {}
        known = self.young.get
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.split or not _PLAIN.fullmatch(t) or any(a in t for a in self.added):
                odd.append(i)
                continue
            words = _SPLIT.findall(t)
            ids = list(map(known, words))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                lacking = [words[k] for k in gaps]
                miss.update(dict.fromkeys(lacking))
                waiting.append((i, ids, gaps, lacking))
            else:
                out[i] = b"".join(ids)
        if miss:
            got = self._learn(miss)
            for i, ids, gaps, lacking in waiting:
                for k, w in zip(gaps, lacking):
                    ids[k] = got[w]
                out[i] = b"".join(ids)
        if odd:
            for i, b in zip(odd, self._whole([texts[i] for i in odd])):
                out[i] = b
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop what earlier tasks of this worker have cached. Workers live on from
    stage to stage; operators that need memory for texts call this first."""
    for e in _ENCODERS.values():
        e.young, e.old = {}, {}


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
