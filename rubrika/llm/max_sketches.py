"""Ranked lexical search with hashed sketches of maxima and exact rescoring down to a threshold.

An index row holds a document's distinct terms as sorted 64-bit hashes, the impact of each (the part
of its score that does not depend on the query: frequency against length), and a sketch: two tables of
one byte per cell, into which every term's impact, rounded up, is folded by its hash, a cell keeping
the largest. The smaller of a query term's two cells is at least its impact, so the sum over a query's
terms, times their weights, bounds the document's score from above. Tables have ``CELLS`` cells per
distinct term, so the bound is as tight for long documents as for short ones.

A task looks all queries of a block up in the sketches of ``ROWS`` documents at once. For each query
it rescores documents exactly in descending order of bound, and stops at the first bound below its
threshold, the score of the last of the ``top`` best found so far; the threshold lives on for the rest of the task.
What tasks found, ``top`` rows a query at most, meets in one window per query. So no document is left out that
could be among the best, and documents are never paired with queries outside a task.

Queries are read in blocks of ``QUERIES``, each a pass over the index. The driver holds one block with
the frequencies of its terms. Hashes stand for terms: two different terms share one with a
chance below 1e-18 a pair.

Cases: a text that is null or has no term is no document; a query without terms, or whose terms are in
no document, gives no rows; null ids of documents rank last among equal scores; repeated ids and rows are documents
and queries of their own; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrika.llm.common import slices, stored, utf8
from rubrika.llm.words import find, hashes

CELLS = 4
ROWS = 1024
QUERIES = 4096
STEP = 32  # documents rescored at a time
PART_BYTES = 2 << 20
ROUND = 4096  # a sketch's unit of impact
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
INDEX = "doc_id long, terms binary, impacts binary, sketch binary"
FOUND = "query int, item_id long, doc_id long, score long"
LAST = np.int64(2**63 - 1)


def _terms(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For parts of a text column: first row, number of terms per row, hashes of all terms."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, PART_BYTES):
        part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, counts = find(part, edges, GAP)
        yield i, counts, hashes(part, starts, ends)


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Number of documents with a term, and of all their terms."""

    def run(batches):
        for batch in batches:
            n = [0, 0]
            for _, counts, _ in _terms(batch.column(0)):
                n[0] += int((counts > 0).sum())
                n[1] += int(counts.sum())
            yield pa.RecordBatch.from_pydict({"docs": [n[0]], "terms": [n[1]]})

    found = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """The part of a term's score that its frequency and the document's length make."""
    m = np.array([75 + 25 * n * n_docs // n_all for n in n_terms.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def width(distinct: np.ndarray) -> np.ndarray:
    """Cells of each of a sketch's two tables: a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(CELLS * distinct, 16))).astype(np.int64)


def cells(h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's cell in the first and in the second table."""
    wide = mask.astype(np.uint64)
    return (h & wide).astype(np.int64), ((h >> np.uint64(32)) & wide).astype(np.int64) + mask + 1


def _ranges(sizes_: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes_)))


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A byte string for each range of ``values``."""
    edges = (bounds * values.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(values.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def build_index(docs: DataFrame, n_docs: int, n_all: int) -> DataFrame:
    """``doc_id, terms, impacts, sketch`` for each document with a term."""

    def run(batches):
        for batch in batches:
            for i, counts, h in _terms(batch.column(1)):
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(new)
                h, doc, tf = h[first], doc[first], np.diff(first, append=len(new))
                found = np.flatnonzero(counts)
                distinct = np.bincount(doc, minlength=len(counts))[found]
                owner = np.repeat(np.arange(len(found)), distinct)
                impact = impacts(tf, counts[found][owner], n_docs, n_all)
                wide = width(distinct)
                bases = _ranges(2 * wide)
                sketch = np.zeros(bases[-1], np.uint8)
                code = (-(-impact // ROUND)).astype(np.uint8)
                for cell in cells(h, (wide - 1)[owner]):
                    np.maximum.at(sketch, bases[:-1][owner] + cell, code)
                bounds = _ranges(distinct)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(found + i)),
                        _binaries(h.astype("<u8"), bounds),
                        _binaries(impact.astype("<u4"), bounds),
                        _binaries(sketch, bases),
                    ],
                    ["doc_id", "terms", "impacts", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


class Block:
    """Queries of one pass: for each the numbers of its terms among the block's, and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        found = [Counter(h.tolist()) for h in _each([text for _, text in items])]
        self.hashes = np.array(sorted(set().union(*found)), np.uint64)
        self.ids = [key for key, _ in items]
        place = {h: k for k, h in enumerate(self.hashes.tolist())}
        self.terms = [np.array([place[h] for h in c], np.int64) for c in found]
        self.times = [np.array(list(c.values()), np.int64) for c in found]

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Weights of the terms of each query; a term in no document weighs nothing."""
        weight = np.zeros(len(self.hashes), np.int64)
        for term, n in df.items():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.weights = [times * weight[terms] for terms, times in zip(self.terms, self.times)]
        for q, weights in enumerate(self.weights):
            self.terms[q], self.weights[q] = self.terms[q][weights > 0], weights[weights > 0]


def _each(texts: list[str | None]) -> list[np.ndarray]:
    found = []
    for _, counts, h in _terms(pa.array(texts, pa.large_string())):
        found += np.split(h, np.cumsum(counts)[:-1])
    return found


def frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each of the sorted hashes ``wanted`` is, by number; absent ones are left out."""

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            h = np.frombuffer(utf8(batch.column(0))[0], "<u8")
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            total += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    if not len(wanted):
        return {}
    counted = index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {row["term"]: row["n"] for row in counted.collect()}


class Documents:
    """Index rows of one step as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        raw = [utf8(batch.column(k)) for k in (1, 2, 3)]
        self.terms, self.impacts = np.frombuffer(raw[0][0], "<u8"), np.frombuffer(raw[1][0], "<u4")
        self.sketch, self.at = raw[2][0], raw[2][1][:-1]
        self.edges = raw[0][1] // 8
        self.mask = np.diff(raw[2][1]) // 2 - 1
        ids = batch.column(0)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(LAST.item()).to_numpy(zero_copy_only=False)

    def bounds(self, h: np.ndarray) -> np.ndarray:
        """Upper bounds of the impacts of terms (rows) in documents (columns), in units of ``ROUND``."""
        found = np.empty((len(h), len(self.at)), np.float64)
        for k, term in enumerate(h):
            one, two = cells(term, self.mask)
            found[k] = np.minimum(self.sketch[self.at + one], self.sketch[self.at + two])
        return found

    def scores(self, docs: np.ndarray, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents: each term sought in each document's sorted terms."""
        low = np.repeat(self.edges[docs], len(h)).reshape(len(docs), len(h))
        end = self.edges[docs + 1][:, None]
        high = np.broadcast_to(end, low.shape).copy()
        for _ in range(int((high - low).max()).bit_length()):
            middle = (low + high) // 2
            less = self.terms[np.minimum(middle, len(self.terms) - 1)] < h
            open_ = low < high
            low = np.where(less & open_, middle + 1, low)
            high = np.where(~less & open_, middle, high)
        at = np.minimum(low, len(self.terms) - 1)
        hit = (low < end) & (self.terms[at] == h)
        return (np.where(hit, self.impacts[at], 0).astype(np.int64) * weights).sum(axis=1)


class Best:
    """The best documents of one query that a task has found, best first, and the threshold."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = scores >= self.threshold
        if not some.any():
            return
        scores, ids = np.append(self.scores, scores[some]), np.append(self.ids, ids[some])
        null = np.append(self.null, null[some])
        order = np.lexsort((ids, null, -scores))[: self.top]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def rescore(docs: Documents, bound: np.ndarray, best: Best, h: np.ndarray, weights: np.ndarray) -> int:
    """Exact scores in descending order of bound until it falls below the threshold. Returns how many."""
    near = np.flatnonzero(bound >= best.threshold)
    near = near[np.argsort(-bound[near], kind="stable")]
    done = 0
    while done < len(near) and bound[near[done]] >= best.threshold:
        some = near[done : done + STEP]
        best.add(docs.scores(some, h, weights), docs.ids[some], docs.null[some])
        done += len(some)
    return done


def _search(block: Block, top: int):
    def run(batches):
        found = [Best(top) for _ in block.ids]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                docs = Documents(batch.slice(at, ROWS))
                for low in range(0, len(block.ids), 256):
                    part = range(low, min(low + 256, len(block.ids)))
                    terms = np.unique(np.concatenate([block.terms[q] for q in part]))
                    cell = docs.bounds(block.hashes[terms])
                    for q in part:
                        if len(block.terms[q]):
                            bound = block.weights[q].astype(np.float64) @ cell[np.searchsorted(terms, block.terms[q])]
                            h = block.hashes[block.terms[q]]
                            rescore(docs, bound * ROUND, found[q], h, block.weights[q])
        counts = [len(b.scores) for b in found]
        null = np.concatenate([b.null for b in found])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(found)), counts), pa.int32()),
                pa.array([key for key, n in zip(block.ids, counts) for _ in range(n)], pa.int64()),
                pa.array(np.concatenate([b.ids for b in found]), pa.int64(), mask=null),
                pa.array(np.concatenate([b.scores for b in found]), pa.int64()),
            ],
            ["query", "item_id", "doc_id", "score"],
        )

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents for each item."""
    n_docs, n_all = sizes(docs)
    index = stored(build_index(docs, n_docs, max(n_all, 1)), "sketches")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    result, waiting = None, []

    def one_pass(rows):
        block = Block(rows)
        block.weigh(frequencies(index, block.hashes), n_docs)
        found = index.mapInArrow(_search(block, top), FOUND)
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).drop("query")

    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        waiting.append((row[0], row[1]))
        if len(waiting) == QUERIES:
            found, waiting = stored(one_pass(waiting), "ranked"), []
            result = found if result is None else result.union(found)
    if waiting:
        found = one_pass(waiting)
        result = found if result is None else result.union(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, rank int")
    return result.select("item_id", "rank", "doc_id", "score")
