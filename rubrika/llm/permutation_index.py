"""Approximate nearest neighbours with a permutation index.

A bounded sample of ``PIVOTS`` vectors are the pivots. A vector is represented by the order of its
``ORDER`` nearest pivots and posted in the files of the first ``POSTED`` of them. A query opens the
files of all pivots of its own order, ranks what it finds there by Spearman's footrule between the
two orders (a pivot that one order lacks counts as the place after its last), and the best ``SHARE``
of each file are ranked again by the exact inner product in double precision.

Nearness is the inner product; pivots are compared in one more dimension that gives all vectors the
length of the longest, where the largest inner product is the smallest distance. Files are split
into tiles of ``TILE`` vectors and ``BLOCK`` queries, which Spark spreads; the best of a tile leave it.

Every row is indexed. Only of equal vectors those beyond the first ``top + 1`` by id are left out:
they can never be among the ``top`` nearest of any query. Measured recall at 20 is in the README.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without id; only vectors of the pivots' length (the most frequent one) are searched; rows
that repeat an id and vector count once, an id with several vectors keeps its best; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rubrika.llm.common import stored
from rubrika.llm.vectors import doubles, usable

PIVOTS = 128
ORDER = 32
POSTED = 16
SHARE = 0.4
LEAST = 64
TILE = 4096
BLOCK = 4096
# A task takes so many queries of a block, rows of a tile and pairs to rank at a time.
QUERIES = 64
ROWS = 1024
PAIRS = 1 << 15
FOUND = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _packed(column, kind) -> np.ndarray:
    """A row for each of equally long byte strings."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _orders(x: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    if query:
        s = x @ pivots[:, :-1].T
    else:
        rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
        s = x @ pivots[:, :-1].T + rest[:, None] * pivots[None, :, -1]
    return np.argsort(-s, axis=1, kind="stable")[:, :ORDER]


def _represent(pivots: np.ndarray, longest: float, query: bool):
    def work(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["embedding"])
            orders = _orders(x, pivots, longest, query).astype(np.uint16)
            yield frame.assign(embedding=[v.tobytes() for v in x], order=[o.tobytes() for o in orders])

    return work


def _footrules(asked: np.ndarray, order: np.ndarray, pivots: int) -> np.ndarray:
    """A row per query of Spearman's footrule to each posted order, less a constant of the query."""
    width = order.shape[1]
    place = np.full((pivots, len(asked)), width, np.int16)
    place[asked, np.arange(len(asked))[:, None]] = np.arange(width, dtype=np.int16)
    found = np.empty((len(asked), len(order)), np.int16)
    # Pivots of the query alone add up to a constant less what both share. The cost of a pivot at one
    # place is looked up for all queries at once.
    costs = [np.abs(place - np.int16(i)) - (np.int16(width) - place) for i in range(width)]
    for start in range(0, len(order), ROWS):
        part = order[start : start + ROWS]
        total = costs[0][part[:, 0]]
        for i in range(1, width):
            total += costs[i].take(part[:, i], axis=0)
        found[:, start : start + ROWS] = total.T
    return found


def _best(queries: tuple, posted: tuple, top: int, pivots: int) -> pd.DataFrame:
    """The best of a tile, ordered by id, for a few queries: of each query's short list the nearest.

    One matrix product tells which rows can be among them; those are ranked by sums that do not depend
    on where a row stands, so that equal vectors have equal scores.
    """
    (query, vectors, asked), (ids, x, order) = queries, posted
    keep = max(LEAST, top + 1, int(np.ceil(SHARE * len(ids))))
    listed = np.ones((len(query), len(ids)), bool)
    if keep < len(ids):
        footrules = _footrules(asked, order, pivots)
        listed = footrules <= np.partition(footrules, keep - 1, axis=1)[:, keep - 1 : keep]
    first, last = np.searchsorted(ids, query), np.searchsorted(ids, query, "right")
    for q in np.flatnonzero(first < last):
        listed[q, first[q] : last[q]] = False
    with np.errstate(all="ignore"):  # a product of finite numbers may not be finite
        rough = vectors @ x.T
        rough[~listed] = -np.inf
        last = min(top, len(ids)) - 1
        least = -np.partition(-rough, last, axis=1)[:, last]
        error = 1e-12 * np.sqrt((vectors * vectors).sum(1)) * np.sqrt((x * x).sum(1).max())
        at, row = np.nonzero(listed & ~(rough < (least - error)[:, None]))
        parts = [slice(i, i + PAIRS) for i in range(0, len(at), PAIRS)]
        score = np.concatenate([np.zeros(0), *[(vectors[at[p]] * x[row[p]]).sum(1) for p in parts]])
    ranked = np.lexsort((ids[row], -score, at))
    at, row, score = at[ranked], row[ranked], score[ranked]
    some = np.arange(len(at)) - np.searchsorted(at, at) < top
    return pd.DataFrame({"query_id": query[at[some]], "vec_id": ids[row[some]], "score": score[some]})


def _search(top: int):
    def tile(queries: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(posted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        posted = posted.sort_values("vec_id", kind="stable")
        there = posted["vec_id"].to_numpy(), _packed(posted["embedding"], np.float64), _packed(posted["order"], np.uint16)
        asked = queries["query_id"].to_numpy(), _packed(queries["embedding"], np.float64), _packed(queries["order"], np.uint16)
        pivots = int(max(there[2].max(), asked[2].max())) + 1
        few = [tuple(a[i : i + QUERIES] for a in asked) for i in range(0, len(queries), QUERIES)]
        return pd.concat([_best(part, there, top, pivots) for part in few])

    return tile


def nearest(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows that each query row finds among
    all other rows of ``vectors`` (vec_id, embedding)."""
    rows = doubles(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    rows = rows.where(usable() & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    usual = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = usual[0]["dim"] if usual else 0
    rows = rows.where(F.col("dim") == dim).drop("dim")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    longest = rows.agg(F.max(norm)).head()[0] or 1.0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = _matrix([r["embedding"] for r in sample]) if sample else np.zeros((0, dim))
    rest = np.sqrt(np.maximum(longest**2 - (pivots * pivots).sum(1), 0))
    pivots = np.hstack([pivots, rest[:, None]])
    spec = "vec_id long, embedding binary, order binary"
    copy = W.partitionBy("embedding").orderBy("vec_id")
    indexed = (
        rows.dropDuplicates(["vec_id", "embedding"])
        .withColumn("copy", F.row_number().over(copy))
        .where(F.col("copy") <= top + 1)
        .drop("copy")
    )
    indexed = stored(indexed.mapInPandas(_represent(pivots, longest, False), spec), "index")
    asked = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    asked = stored(asked.mapInPandas(_represent(pivots, longest, True), spec), "queries")

    pivot_of = F.pandas_udf(lambda o: o.map(lambda b: np.frombuffer(b, np.uint16).astype(np.int32)), "array<int>")
    posted = indexed.withColumn("pivot", F.explode(F.slice(pivot_of("order"), 1, POSTED)))
    opened = asked.withColumn("pivot", F.explode(pivot_of("order"))).withColumnRenamed("vec_id", "query_id")
    tiles = posted.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    blocks = opened.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    shape = stored(tiles.join(blocks, "pivot"), "files")  # a row per pivot
    zero = F.lit(0).cast("long")
    posted = (
        posted.join(F.broadcast(shape), "pivot")
        .withColumn("tile", F.pmod(F.xxhash64("vec_id"), "tiles"))
        .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .drop("tiles", "blocks")
    )
    opened = (
        opened.join(F.broadcast(shape), "pivot")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
        .withColumn("tile", F.explode(F.sequence(zero, F.col("tiles") - 1)))
        .drop("tiles", "blocks")
    )
    key = ["pivot", "tile", "block"]
    found = opened.groupBy(*key).cogroup(posted.groupBy(*key)).applyInPandas(_search(top), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
