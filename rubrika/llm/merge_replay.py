"""Byte-level BPE by replaying the merges over many words at once, and back to bytes.

A text is cut by the tokenizer's pattern. A task gathers the distinct pieces of its documents, lays
their bytes out in one chain of symbols, and keeps an inverted index from the rank of a pair of
neighbours to the positions where it stands. The merges are then applied in rank order, each to all
its positions in all pieces; only the pairs beside a merge are looked up again and enter the index.
Ids of the pieces are remembered, so each is replayed once per worker as long as the memory for them
(``MEMO_BYTES``) lasts; ids of documents are put together from them. There is no shuffle: at any
size a task needs only its own documents and the ranks.

Rank order equals the usual rule (of one piece, the pair of lowest rank first, the leftmost of
equals) as long as a merge makes no pair of a rank that has passed. Where that happens, the piece is
merged alone by the rule. A piece that is a token by itself is that token.

Bounds: pieces are replayed in blocks of ``BLOCK_BYTES`` (one longer piece is a block of its own, at
about 30 bytes of memory a byte), texts are cut in windows of ``WINDOW`` characters, which never cut
a piece, and results leave in parts of ``PART_BYTES`` of text.

Cases: a null text is an empty text and has no ids; bytes that are not UTF-8 are read as U+FFFD; null
and repeated ids are kept row by row; an empty table gives no rows; columns other than the key and the text
are not read. Null ids decode to null; an id outside the ranks fails the query.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from rubrika.llm.common import slices, utf8

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 2 << 20
MEMO_BYTES = 72 << 20
PIECE_COST = 170  # bytes that a remembered piece takes beside its text and ids
RANK_SPAN = 512
WINDOW = 1 << 19
PART_BYTES = 4 << 20
FEW = 24  # positions that are merged one by one
NONE = 2**31 - 1
NEVER = np.int32(NONE)
NOWHERE = np.zeros(0, np.int32)
_workers: dict[str, "Replay"] = {}


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Splitter:
    """Pieces of a text by the public pattern. Letters, numbers and spaces are those of the
    library whose ids these are, as versions of Unicode differ."""

    def __init__(self):
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        kinds = {}
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            found = tiktoken.Encoding("kind", pat_str=kind + "+", mergeable_ranks=single, special_tokens={})
            codes = np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")
            edge = np.flatnonzero(np.diff(codes) != 1)
            kinds[kind] = list(zip(codes[[0, *(edge + 1)]].tolist(), codes[[*edge, -1]].tolist()))
        # Sets without the rare code points from U+10000 on are much faster.
        self.common = self._compiled(kinds, 0x10000)
        self.whole = self._compiled(kinds, 0x110000)

    @staticmethod
    def _compiled(kinds: dict[str, list], top: int) -> re.Pattern:
        pattern = public_tokenizers.PATTERN.replace(r"\S", r"[^\s]")
        sets = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v if a < top) for k, v in kinds.items()}
        inside = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: "[" + m[1] + _filled(m[2], sets) + "]", pattern)
        return re.compile(re.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{sets[m[0]]}]", inside))

    def pieces(self, text: str, window: int = WINDOW) -> Iterator[list[str]]:
        """The pieces in order, a list for each window. What a piece is depends on at most two
        characters after it, so those that end further from the window's end are pieces of the text;
        the next window starts after them."""
        pattern = self.common if text.isascii() or max(text, default="") < "\U00010000" else self.whole
        at, size = 0, window
        while at < len(text):
            found = pattern.findall(text, at, at + size)
            end = len(text)
            if at + size < len(text):
                end = at + sum(map(len, found))
                while found and end > at + size - 2:
                    end -= len(found.pop())
            if found:
                yield found
                at, size = end, window
            else:
                size *= 2


def _filled(inner: str, sets: dict[str, str]) -> str:
    for kind, chars in sets.items():
        inner = inner.replace(kind, chars)
    return inner


class Replay:
    """The merges of a vocabulary, and the pieces that this worker has seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.count = max(ranks.values()) + 1
        self.base = self.count + 1  # one symbol more: the end of a piece
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    merged.append(rank)
        self.pairs = dict(zip(keys, merged))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.merged = np.append(np.array(merged, np.int32)[order], NEVER)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * self.count
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, self.count))
        self.sizes = np.diff(self.ends, prepend=0)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.held = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.merged[at], NEVER)

    def merge_alone(self, word: bytes) -> list[int]:
        """The rule for one piece: the pair of lowest rank, the leftmost of equals, again and again."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids begin and end."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        symbol = np.append(self.single[data], np.int32(self.count))
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[firsts] = n
        rank = np.append(self._rank(symbol[:-1], symbol[after[:-1]]), NEVER)

        # The index: positions by the rank of the pair that begins there, put in order for a span of
        # ranks when their turn comes.
        waiting, single = [np.flatnonzero(rank != NEVER).astype(np.int32)], []
        passed: list[int] = []
        chain = [memoryview(a) for a in (symbol, after, before, rank)]
        for top in range(RANK_SPAN, self.count + RANK_SPAN, RANK_SPAN):
            at = np.concatenate((*waiting, np.array(single, np.int32)))
            turn = rank[at]
            waiting, single, at = [at[(turn >= top) & (turn != NEVER)]], [], at[turn < top]
            if not len(at):
                continue
            at = at[np.argsort(rank[at], kind="stable")]
            ranks, edges = np.unique(rank[at], return_index=True)
            index = dict(zip(ranks.tolist(), np.split(at, edges[1:])))
            later: dict[int, list[int]] = {}
            heap = ranks.tolist()  # in order, hence a heap
            while heap:
                r = heappop(heap)
                at, more = index.pop(r, NOWHERE), later.pop(r, [])
                if len(at) + len(more) <= FEW:
                    self._merge_few(r, sorted({*at.tolist(), *more}), n, chain, (top, later, index, heap, single, passed))
                    continue
                at = np.concatenate((at, np.array(more, np.int32)))
                at = np.unique(at[rank[at] == r])
                if not len(at):
                    continue
                if len(at) > 1:
                    # Pairs that share a symbol: the leftmost, then every other one.
                    chained = np.append(False, at[1:] == after[at[:-1]])
                    if chained.any():
                        spot = np.arange(len(at))
                        start = np.maximum.accumulate(np.where(chained, 0, spot))
                        at = at[(spot - start) % 2 == 0]
                gone = after[at]
                beyond = after[gone]
                symbol[at], after[at], before[beyond] = r, beyond, at
                rank[gone] = NEVER
                touched = np.concatenate((at, before[at]))
                touched = touched[touched != n]
                new = self._rank(symbol[touched], symbol[after[touched]])
                rank[touched] = new
                soon = new < top
                for k, p in zip(new[soon].tolist(), touched[soon].tolist()):
                    _wait(k, p, r, later, index, heap, passed)
                waiting.append(touched[~soon & (new != NEVER)])

        alive = np.zeros(n, bool)
        alive[self._heads(firsts, after, n)] = True
        flat = symbol[:-1][alive]
        bounds = np.concatenate(([0], np.cumsum(alive)))[np.append(firsts, n)]
        if passed:
            flat, bounds = self._again(words, flat, bounds, ends, np.array(passed))
        return flat, bounds

    def _merge_few(self, r: int, at: list[int], n: int, chain: list[memoryview], places: tuple) -> None:
        """Merge a few positions one by one, from the left: a pair whose symbol is gone is passed over."""
        symbol, after, before, rank = chain
        top, later, index, heap, single, passed = places
        for p in at:
            if rank[p] != r:
                continue
            gone = after[p]
            beyond = after[gone]
            symbol[p], after[p], before[beyond], rank[gone] = r, beyond, p, NONE
            q = before[p]
            for left, right in ((p, beyond), (q, p)):
                if left == n:
                    continue
                k = self.pairs.get(symbol[left] * self.base + symbol[right], NONE)
                rank[left] = k
                if k < top:
                    _wait(k, left, r, later, index, heap, passed)
                elif k != NONE:
                    single.append(left)

    @staticmethod
    def _heads(firsts: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
        """Positions of the symbols that are left: from each word's first along its chain."""
        found, at = [], firsts[firsts < n]
        while len(at):
            found.append(at)
            at = after[at]
            at = at[at != n]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _again(self, words, flat, bounds, ends, at):
        """The words in which a merge made a pair whose rank had passed, merged alone."""
        hit = set(np.searchsorted(ends, at, side="right").tolist())
        parts = [
            np.array(self.merge_alone(words[k]), np.int32) if k in hit else flat[bounds[k] : bounds[k + 1]]
            for k in range(len(words))
        ]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _remember(self, pieces: list[str], flat: np.ndarray, bounds: np.ndarray) -> None:
        n, total = len(self.memo), len(flat)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + len(pieces) > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.pool[self.used : self.used + total] = flat
        self.starts[n : n + len(pieces)] = self.used + bounds[:-1]
        self.lengths[n : n + len(pieces)] = np.diff(bounds)
        self.used += total
        self.held += PIECE_COST * len(pieces) + 4 * total + sum(map(len, pieces))
        self.memo.update(zip(pieces, range(n, n + len(pieces))))

    def _learn(self, pieces: list[str]) -> None:
        """Replay pieces that are new, a block at a time."""
        whole = [p for p in pieces if p.encode() in self.ranks]
        ids = np.array([self.ranks[p.encode()] for p in whole], np.int32)
        self._remember(whole, ids, np.arange(len(whole) + 1))
        rest = [p for p in pieces if p not in self.memo]
        block, words, size = [], [], 0
        for piece in [*rest, None]:
            if piece is None or size > BLOCK_BYTES:
                if block:
                    self._remember(block, *self.replay(words))
                block, words, size = [], [], 0
            if piece is not None:
                block.append(piece)
                words.append(piece.encode())
                size += len(words[-1])

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and where each piece's ids begin and end."""
        if self.held > MEMO_BYTES:
            self._forget()
        at = list(map(self.memo.get, pieces))
        if None in at:
            self._learn(sorted({piece for piece, place in zip(pieces, at) if place is None}))
            at = list(map(self.memo.get, pieces))
        at = np.array(at, np.int64)
        lengths = self.lengths[at]
        return gather(self.pool, self.starts[at], lengths), np.concatenate(([0], np.cumsum(lengths)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one after another."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.count or not self.sizes[ids].all()):
            raise ValueError("an id is not in the ranks")
        sizes = self.sizes[ids]
        return gather(self.bytes, self.ends[ids] - sizes, sizes)


def _wait(k: int, p: int, r: int, later: dict, index: dict, heap: list, passed: list) -> None:
    """Enter position ``p`` under rank ``k`` while rank ``r`` is merged."""
    if k < r:
        passed.append(p)
    if k in later:
        later[k].append(p)
    else:
        later[k] = [p]
        if k not in index:
            heappush(heap, k)


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranges of ``pool``, one after another."""
    total = np.cumsum(sizes)
    if not len(total):
        return pool[:0]
    return pool[np.arange(total[-1]) + np.repeat(starts - (total - sizes), sizes)]


def worker(name: str) -> Replay:
    if name not in _workers:
        _workers[name] = Replay(read_ranks(name))
        _workers[name].splitter = Splitter()
    return _workers[name]


def encode_column(work: Replay, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of a text column: the ids, and where each row's ids begin and end."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, PART_BYTES):
        counts, parts = np.zeros(j - i, np.int64), []
        pieces, rows, ends = [], [], []

        def flush():
            ids, bounds = work.encode(pieces)
            np.add.at(counts, rows, np.diff(bounds[ends], prepend=0))
            parts.append(ids)

        for row in range(j - i):
            text = data[offsets[i + row] : offsets[i + row + 1]].tobytes().decode("utf-8", "replace")
            for found in work.splitter.pieces(text):
                pieces += found
                rows.append(row)
                ends.append(len(pieces))
                if len(pieces) > WINDOW:
                    flush()
                    pieces, rows, ends = [], [], []
        if pieces:
            flush()
        yield np.concatenate(parts or [np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum(counts)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``key, ids``: the ids of each text, in order."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker(ranks)
        for batch in batches:
            at = 0
            for ids, bounds in encode_column(work, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), lists], ["key", "ids"])
                at += len(lists)

    found = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return found.withColumnRenamed("key", key)


def _parts(lists: pa.ListArray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an id column of about ``limit`` ids: first and last row, ids, bounds."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
    values = lists.flatten().to_numpy(zero_copy_only=False)
    for i, j in slices(offsets, limit):
        yield i, j, values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``key, ids, decoded``: the bytes that the ids stand for."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker(ranks)
        for batch in batches:
            lists = batch.column(1)
            for i, j, values, bounds in _parts(lists, PART_BYTES // 4):
                raw = work.decode(values)
                edges = np.concatenate(([0], np.cumsum(work.sizes[values])))[bounds].astype(np.int32)
                empty = lists.slice(i, j - i).is_null()
                texts = pa.Array.from_buffers(
                    pa.binary(), j - i, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes())]
                )
                if lists.null_count:
                    texts = pa.compute.if_else(empty, pa.scalar(None, pa.binary()), texts)
                columns = [batch.column(0).slice(i, j - i), lists.slice(i, j - i), texts]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"])

    found = df.select(df[key].alias("key"), df[ids].alias("ids"))
    return found.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def ids_digest(df: DataFrame, ids: str = "ids", name: str = "ids_sha256") -> DataFrame:
    """Adds the SHA-256 of the ids in decimals with a space between, in lowercase hexadecimals.
    A part of a long row is hashed at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, values, bounds in _parts(batch.column(ids), PART_BYTES // 4):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    digest = sha256()
                    for k in range(a, b, WINDOW):
                        digest.update((" " * (k > a) + " ".join(map(str, values[k : min(b, k + WINDOW)].tolist()))).encode())
                    found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())]))
