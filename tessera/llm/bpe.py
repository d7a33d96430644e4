"""Ids of the byte-level BPE tokenizer: texts are cut into its pre-tokens in numpy, and each distinct one is encoded once.

Equal to Tokenizer.encode(text, add_special_tokens=False). The tokenizer's own pre-tokenizer cuts at
's 't 're 've 'm 'll 'd | ?letters | ?digits | ?others | white space. All but the contractions follow from classes of
neighbouring characters. A text with a contraction, or with the string of a special token, is encoded whole instead.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from .common import hash_spans

_SLOW = re.compile(r"'(?:s|t|re|ve|m|ll|d)|<\|endoftext\|>")
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SLICE = 3 << 19
#: Distinct pre-tokens that a worker remembers, about 40 bytes each; beyond that it starts anew.
_CACHE_LIMIT = 2_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    """0 other, 1 letter, 2 digit, 3 white space, for every code point."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    kind[major == ord("L")] = 1
    kind[major == ord("N")] = 2
    kind[_WHITE] = 3
    return kind


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kinds = _kinds()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if ("'" in text or "<|" in text) and _SLOW.search(text):
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(k)
        if plain:
            for k, ids in zip(plain, self._encode([texts[k] for k in plain])):
                out[k] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        text = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not text:
            return [np.zeros(0, np.uint32)] * len(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        head = np.zeros(points.size, bool)
        head[bounds[:-1][np.diff(bounds) > 0]] = True
        edge = head.copy()
        edge[1:] |= kind[1:] != kind[:-1]
        # The last of a run of white space before other characters: a blank joins them, another stands alone.
        white = kind == 3
        last = np.zeros(points.size, bool)
        last[:-1] = white[:-1] & ~white[1:] & ~head[1:]
        at = np.flatnonzero(last)
        edge[at] = True
        blank = at[points[at] == 32]
        edge[blank + 1] = False
        begin = np.flatnonzero(edge)
        wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
        data = text.encode()
        start = offsets[begin]
        length = np.diff(np.append(start, offsets[-1]))
        hashes = hash_spans(np.frombuffer(data + bytes(8), np.uint8), start, length)
        slot = self._slots(hashes, data, start, length)
        counts = self.lengths[slot]
        ends = np.cumsum(counts)
        where = np.repeat(self.starts[slot] - (ends - counts), counts) + np.arange(ends[-1])
        ids = self.ids[where]
        upto = np.concatenate([[0], ends])[np.searchsorted(begin, bounds)]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _slots(self, hashes, data, start, length) -> np.ndarray:
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = at < self.hashes.size
        known[known] = self.hashes[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        if new.size:
            if self.hashes.size + new.size > _CACHE_LIMIT and self.hashes.size:
                self.clear()
                return self._slots(hashes, data, start, length)
            spans = [data[a:b].decode() for a, b in zip(start[first[new]].tolist(), (start + length)[first[new]].tolist())]
            coded = [x.ids for x in self.whole.encode_batch(spans, add_special_tokens=False)]
            sizes = np.array([len(x) for x in coded], np.int64)
            starts = self.ids.size + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.ids = np.concatenate([self.ids, np.array([i for x in coded for i in x], np.uint32)])
            self.hashes, self.starts, self.lengths = (np.insert(x, at[new], y) for x, y in ((self.hashes, unique[new]), (self.starts, starts), (self.lengths, sizes)))
            at = np.searchsorted(self.hashes, unique)
        return at[back.reshape(-1)]


_encoders: dict[str, Encoder] = {}


def ids_of(path: str, column: pa.Array):
    """(first row, ids of each row) of runs of rows; null counts as empty."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    n, at = len(column), 0
    while at < n:
        texts, size = [], 0
        while at + len(texts) < n and (not texts or size < _SLICE) and len(texts) < 20_000:
            texts.append(column[at + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield at, _encoders[path].encode(texts)
        at += len(texts)
