"""Spelling variants: words one edit apart, found by dense comparison of blocks of words.

Two words whose longer one has M code points are one insertion, deletion or replacement apart exactly
if their common prefix and common suffix together reach M - 1. Words are laid out as padded matrices of code
points, once from the left and once from the right, and blocks of at most ``BLOCK`` rows are compared
whole: a tile gives both lengths for each pair of its rows.

Which rows meet: the end of a pair's common prefix lies in the first or the second half of the M places.
In the second half, both words begin with the same M // 2 code points; in the first, they end alike from
there on. So a word joins one group by its head and one by its tail, for M its own length and
one more. A group of more than ``GROUP`` words is split again in the same way by the halves of the places
still open, on and on, until one place is open: then its words differ in that place alone, and the alphabet bounds them. A pair
counts only in the group whose open places hold the end of its common prefix, hence once. No group
is ever gathered before its size is known to be bounded.

A word's form is its near word with the most occurrences (of equals the first by code point) if that has ``RATIO`` times
the word's own; roots are reached by doubling the steps along forms, as occurrences grow by ``RATIO``
a step and chains are short.

Cases: a null text has no words; an empty table gives no rows; bytes that are not UTF-8 are read as
U+FFFD; a null id is written as empty text in front of the colon; repeated ids and rows count again; columns other
than id and text are not read. Words of any length are compared; a block of very long words has fewer rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import stored, utf8

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z have become a-z
LEAST_CHARS = 6
LEAST_COUNT = 5
DAMAGED = 199
RATIO = 5
BLOCK = 64
TILE_CELLS = 1 << 21
GROUP = 512
HELD_WORDS = 150_000
LONG_TEXT = 1 << 20
BROADCAST_GROUPS = 100_000
KEYS = ("m", "low", "high", "head", "tail")
PAIRS = "word string, n long, near string, near_n long"


def damaged(run: str, prefix: int) -> str:
    """The run without one code point, for one run of ``DAMAGED``; ``prefix`` is the checksum of the
    document's id and a colon."""
    h = crc32(run.encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _runs(text: str) -> Iterator[Counter]:
    """Runs with their numbers; a long text in parts."""
    if len(text) <= LONG_TEXT:
        yield Counter(RUN.findall(text))
        return
    some: Counter = Counter()
    for found in RUN.finditer(text):
        some[found[0]] += 1
        if len(some) > HELD_WORDS:
            yield some
            some = Counter()
    yield some


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: words of at least ``LEAST_CHARS`` code points with at least ``LEAST_COUNT``
    occurrences in all documents. A task adds up what it holds before the shuffle."""

    def partial(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())}
        )

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for k, key in enumerate(keys):
                text = data[offsets[k] : offsets[k + 1]].tobytes().lower().decode("utf-8", "replace")
                prefix = crc32(f"{'' if key is None else key}:".encode())
                for found in _runs(text):
                    for word, n in found.items():
                        if len(word) >= LEAST_CHARS:
                            word = damaged(word, prefix)
                            if len(word) >= LEAST_CHARS:
                                total[word] += n
                    if len(total) > HELD_WORDS:
                        yield partial(total)
                        total = Counter()
        yield partial(total)

    words = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows with the open places [low, high) of their group, and what stands before and after them."""
    placed = rows.withColumns({"low": low, "high": high})
    return placed.withColumns(
        {
            "head": F.substr("word", F.lit(1), F.col("low")),
            "tail": F.when(F.col("m") > F.col("high"), F.right("word", F.col("m") - F.col("high"))).otherwise(""),
        }
    )


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the group of the first and of the second half of its open places."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    both = F.explode(
        F.array(
            F.struct(F.col("low").alias("a"), middle.alias("b")),
            F.struct(middle.alias("a"), F.col("high").alias("b")),
        )
    )
    split = rows.withColumn("half", both)
    return _keyed(split, F.col("half.a"), F.col("half.b")).select(*KEYS, "word", "n")


def groups(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """Words by group, no group with two or more open places over ``limit`` words."""
    length = F.char_length("word")
    start = words.withColumn("m", F.explode(F.array(length, length + 1)))
    rows = _halves(start.withColumns({"low": F.lit(0), "high": F.col("m")}))
    small = []
    while True:
        rows = stored(rows, "groups")
        counted = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"))
        large = stored(counted.where((F.col("size") > limit) & (F.col("high") - F.col("low") > 1)).drop("size"), "large")
        n = large.count()
        if not n:
            small.append(rows)
            break
        large = F.broadcast(large) if n <= BROADCAST_GROUPS else large
        small.append(rows.join(large, list(KEYS), "left_anti"))
        rows = _halves(rows.join(large, list(KEYS), "left_semi"))
    found = small[0]
    for other in small[1:]:
        found = found.union(other)
    return found


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, padded on the right, and from the end backwards."""
    forward = np.zeros((len(words), width), np.int32)
    backward = np.zeros((len(words), width), np.int32)
    for k, word in enumerate(words):
        codes = np.frombuffer(word.encode("utf-32-le"), "<i4")
        forward[k, : len(codes)] = codes
        backward[k, : len(codes)] = codes[::-1]
    return forward, backward


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and of ``b`` how many places are equal from the start."""
    other = a[:, None, :] != b[None, :, :]
    return np.where(other.any(axis=2), other.argmax(axis=2), a.shape[1])


def tiles(words: list[str], group: np.ndarray, low: np.ndarray, high: np.ndarray, m: int) -> np.ndarray:
    """Pairs of rows one edit apart whose longer word has ``m`` code points. Rows of a group follow each
    other; a block may hold several groups, and blocks meet where a group spans both."""
    if not len(words):
        return np.zeros((0, 2), np.int64)
    forward, backward = matrices(words, m)
    whole = np.fromiter(map(len, words), np.int64, len(words)) == m
    size = max(1, min(BLOCK, int((TILE_CELLS / m) ** 0.5)))
    found = []
    for p in range(0, len(words), size):
        a = slice(p, p + size)
        last = group[min(p + size, len(words)) - 1]
        for q in range(p, len(words), size):
            if group[q] > last:
                break
            b = slice(q, q + size)
            head, tail = _common(forward[a], forward[b]), _common(backward[a], backward[b])
            near = (head + tail >= m - 1) & (group[a][:, None] == group[b][None, :])
            near &= (whole[a][:, None] | whole[b][None, :]) & (head >= low[a][:, None]) & (head < high[a][:, None])
            left, right = np.nonzero(near)
            left, right = left + p, right + q
            once = left < right
            found.append(np.stack((left[once], right[once]), axis=1))
    return np.concatenate(found)


def near_pairs(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, in both orders, once."""

    def run(batches):
        for batch in batches:
            columns = batch.to_pydict()
            by_width: dict[int, tuple[list, list, list, list, list]] = {}
            for k, (m, low, high, rows) in enumerate(zip(*[columns[c] for c in ("m", "low", "high", "rows")])):
                texts, counts, group, lows, highs = by_width.setdefault(m, ([], [], [], [], []))
                texts += [r["word"] for r in rows]
                counts += [r["n"] for r in rows]
                for held, value in ((group, k), (lows, low), (highs, high)):
                    held += [value] * len(rows)
            for m, (texts, counts, *places) in by_width.items():
                pairs = tiles(texts, *[np.array(p, np.int64) for p in places], m)
                if len(pairs):
                    text, count = pa.array(texts, pa.string()), pa.array(counts, pa.int64())
                    one, two = np.concatenate((pairs, pairs[:, ::-1])).T
                    ends = [pa.array(one), pa.array(two)]
                    yield pa.RecordBatch.from_arrays(
                        [part.take(end) for end in ends for part in (text, count)], ["word", "n", "near", "near_n"]
                    )

    length = F.char_length("word")
    gathered = (
        groups(words, limit)
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("word", "n")).alias("rows"), F.max(length).alias("longest"))
        .where((F.size("rows") > 1) & (F.col("longest") == F.col("m")))
    )
    return gathered.select("m", "low", "high", "rows").mapInArrow(run, PAIRS)


def roots(steps: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, root`` of one step each, by following steps to the last."""
    steps = stored(steps, "steps")
    while True:
        further = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = steps.join(further, F.col("root") == F.col("at"), "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for rows ``word, n`` of distinct words."""
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(often, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "forms")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    whole = found.join(ends, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
