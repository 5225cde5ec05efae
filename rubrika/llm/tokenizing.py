"""Ids of whole texts with a public tokenizer, each distinct piece encoded once per worker.

Texts are cut where the tokenizers always end a pre-token, each distinct piece is encoded alone, and
the ids are put together with numpy. For the tokenizer that drops white space, pieces are the words.
For the byte-level one they are cut before a single space, around a single line feed, and, for both,
between an ASCII letter and a full stop, comma, colon or semicolon. Texts that hold white space other
than space and line feed are not cut by the byte-level one but encoded whole. No cut falls inside a
special token's string, which becomes its id, as with the library and the file as it is.

Pieces are told apart by 64-bit hashes; a worker remembers pieces in numpy arrays, found by their sorted
hashes, up to ``MEMO_BYTES``, then starts anew. Texts are worked on in parts of ``CHUNK_BYTES``; a longer one is a part of its own.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from rubrika.llm.common import slices, utf8
from rubrika.llm.words import SPACE, hashes

BYTE_LEVEL = "byte_bpe_50k.json"
WORD_LEVEL = "word_bpe_49k.json"
MEMO_BYTES = 48 << 20
PIECE_COST = 48  # bytes for a remembered piece beside its ids: hash, slot, start, size, room to grow
CHUNK_BYTES = 1 << 19
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,:;"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)  # white space, or the first byte of some
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_BLANK[0x0A] = False
_workers: dict[str, "PieceEncoder"] = {}


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with white space other than space and line feed."""
    hit = _BLANK[data]
    for first, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[:-1] == first)
        at = at[np.isin(data[at + 1], seconds)]
        hit[at] = True
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[offsets]) > 0


class PieceEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.byte_level = name != WORD_LEVEL
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece, in order."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = _MARK[data[1:]] & _LETTER[data[:-1]]
        if self.byte_level:
            space = data == 0x20
            blank = space | (data == 0x0A)
            single = np.zeros(n, bool)
            single[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
            line = single & ~space
            cut[:n] |= single
            cut[1:] |= line
            for k in np.flatnonzero(_odd(data, offsets)):
                cut[offsets[k] : offsets[k + 1]] = False
            cut[offsets] = True
            border = np.flatnonzero(cut)
            return border[:-1], border[1:]
        word = ~SPACE[data]
        cut[offsets] = True
        before = np.concatenate(([False], word[:-1]))
        starts = np.flatnonzero(word & (~before | cut[:n]))
        after = np.concatenate((word[1:], [False]))
        return starts, np.flatnonzero(word & (~after | cut[1:])) + 1

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Remembers new pieces in slots of their order."""
        known = len(self.keys)
        for at in range(0, len(keys), 4096):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            ids = [e.ids for e in found]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total, n = int(sizes.sum()), known + at
            while self.used + total > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while n + len(ids) > len(self.sizes):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
                self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.starts[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(ids)] = sizes
            self.used += total
        order = np.argsort(keys)
        places = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, places, keys[order])
        self.slots = np.insert(self.slots, places, (known + order).astype(np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each begins and ends."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if PIECE_COST * len(self.keys) + 4 * self.used > MEMO_BYTES:
            self._forget()
        starts, ends = self._pieces(data, offsets)
        of, kinds = pd.factorize(hashes(data, starts, ends, fold=not self.byte_level))
        top = np.maximum.accumulate(of)
        first = np.flatnonzero(np.concatenate(([True] if len(of) else [], top[1:] > top[:-1])))
        slots = self._slots(kinds)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            slots[new] = np.arange(len(self.keys), len(self.keys) + len(new))
            self._learn(kinds[new], texts)
        places = slots[of]
        sizes = self.sizes[places]
        total = np.cumsum(sizes)
        at = np.arange(total[-1]) if len(total) else np.zeros(0, np.int64)
        flat = self.pool[at + np.repeat(self.starts[places] - (total - sizes), sizes)]
        bounds = np.concatenate(([0], total))[np.searchsorted(starts, offsets)]
        return flat, bounds


def encoder(name: str) -> PieceEncoder:
    if name not in _workers:
        _workers[name] = PieceEncoder(name)
    return _workers[name]


def encode_column(name: str, column):
    """Little-endian unsigned 32-bit ids of each text of an Arrow column, in order; null as empty."""
    work = encoder(name)
    data, offsets = utf8(column)
    for i, j in slices(offsets, CHUNK_BYTES):
        flat, bounds = work.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        raw = flat.astype("<u4").tobytes()
        for a, b in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist()):
            yield raw[a:b]


def encode_texts(name: str, texts: list[str | None]) -> list[bytes]:
    return list(encode_column(name, pa.array(texts, pa.large_string())))
