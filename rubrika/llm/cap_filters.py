"""Near copies among vectors with spherical-cap filters from random product codes.

The dimensions fall into four blocks with ``CODE`` random directions each; a filter is one direction
per block, so there are CODE^4 filters for 4 * CODE stored directions. A vector meets a filter if its
inner product with the filter's direction exceeds a limit. List decoding finds these from the sorted
sums of the first two and the last two blocks without trying all filters; a vector that meets few
takes its best ``LEAST`` filters. Vectors with a common filter and label are compared by their exact
cosine in double precision.

A filter's cell of over ``TILE`` vectors is split at random into parts, and each pair of parts is a
tile of its own, so no task holds more than two parts. Inside a tile pairs stay a matrix: what leaves
it is a count per vector and one link to the smallest connected vector. A pair that shares several
filters counts in the cell of the smallest. Equal vectors are one node with a count.

At the limits used, a pair of cosine 0.98 shares about twelve filters; the tests find no miss.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
label, link with nothing and are their own component; vectors of different lengths are not compared;
a null id takes part and counts, but names no component; rows that repeat an id are vectors of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import shuffle_partitions, stored
from rubrika.llm.components import components
from rubrika.llm.vectors import doubles, usable

COSINE = 0.98
CODE = 16
SHARE = 24 / CODE**4  # of the filters that a random direction exceeds
LEAST = 16
TILE = 512
SEED = 7


def _codes(dim: int) -> list[np.ndarray]:
    """Unit directions of each block; blocks differ in width by one at most."""
    rng = np.random.default_rng(SEED + dim)
    out = []
    for width in (len(x) for x in np.array_split(np.arange(dim), 4)):
        c = rng.standard_normal((CODE, width))
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
    return out


def _limit(codes: list[np.ndarray]) -> float:
    """The inner product that a share ``SHARE`` of (random direction, filter) pairs exceeds."""
    rng = np.random.default_rng(SEED)
    dim = sum(c.shape[1] for c in codes)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = np.split(x, np.cumsum([c.shape[1] for c in codes])[:-1], axis=1)
    total = np.zeros((len(x), 100))
    for c, b in zip(codes, blocks):
        total += np.take_along_axis(b @ c.T, rng.integers(0, CODE, (len(x), 100)), 1)
    return float(np.quantile(total, 1 - SHARE))


def decode(x: np.ndarray, codes: list[np.ndarray], limit: float) -> np.ndarray:
    """The filters that one unit vector meets, ascending."""
    blocks = np.split(x, np.cumsum([c.shape[1] for c in codes])[:-1])
    s = [c @ b for c, b in zip(codes, blocks)]
    first, last = np.add.outer(s[0], s[1]).ravel(), np.add.outer(s[2], s[3]).ravel()
    a, b = np.argsort(-first), np.argsort(-last)
    first, last = first[a], last[b]
    ends = np.searchsorted(-last, first - limit, side="right")
    if ends.sum() < LEAST:
        # The best sums lie in the corner of the two sorted lists.
        corner = first[:LEAST, None] + last[None, :LEAST]
        best = np.argsort(-corner, axis=None, kind="stable")[:LEAST]
        i, j = np.unravel_index(best, corner.shape)
        return np.sort(a[i] * CODE**2 + b[j])
    i = np.repeat(np.arange(len(ends)), ends)
    j = np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
    return np.sort(a[i] * CODE**2 + b[j])


def _filter_rows(batches):
    known: dict[int, tuple] = {}
    for batch in batches:
        out = [[], [], [], [], [], []]
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for label, node, copies, vector in rows:
            x = np.array(vector)
            x /= np.abs(x).max()
            x /= np.linalg.norm(x)
            if len(x) not in known:
                codes = _codes(len(x))
                known[len(x)] = codes, _limit(codes)
            found = decode(x, *known[len(x)])
            raw, lists = x.tobytes(), found.astype("<i4").tobytes()
            out[0] += [f"{label}:{len(x)}:{f}" for f in found]
            out[1] += found.tolist()
            for k, value in ((2, node), (3, copies), (4, raw), (5, lists)):
                out[k] += [value] * len(found)
            if len(out[0]) >= 8192:
                yield _filter_batch(out)
                out = [[], [], [], [], [], []]
        yield _filter_batch(out)


_HITS = "cell string, filter int, node long, copies long, x binary, filters binary"


def _filter_batch(out):
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _HITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _members(lists: list[np.ndarray], below: int) -> np.ndarray:
    """Which vectors meet which of the smaller filters that more than one vector meets."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keep = flat < below
    flat, owner = flat[keep], owner[keep]
    kinds, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    m = np.zeros((len(lists), len(kinds)), np.float32)
    m[owner, at] = 1
    return m[:, counts > 1]


def _tile(rows: list[tuple], cosine: float) -> list[tuple[int, int, int]]:
    """(node, linked vectors, smallest connected node) of one tile's vectors with links."""
    filter_, side = rows[0][1], np.array([r[6] for r in rows])
    nodes, copies = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x = np.stack([np.frombuffer(r[4]) for r in rows])
    near = x @ x.T >= cosine
    if rows[0][7]:  # a tile of two parts: pairs across only
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return []
    near, nodes, copies = near[np.ix_(some, some)], nodes[some], copies[some]
    m = _members([np.frombuffer(rows[k][5], "<i4") for k in some], filter_)
    if m.shape[1]:
        near &= m @ m.T == 0
    degree = near @ copies
    label = nodes.copy()
    far = np.iinfo(np.int64).max
    while True:
        low = np.minimum(label, np.where(near, label[None, :], far).min(1))
        if (low == label).all():
            break
        label = low
    return [(int(a), int(d), int(c)) for a, d, c in zip(nodes, degree, label) if d]


def _tiles(batches, cosine: float):
    """Tiles from rows sorted by tile; a tile may go on in the next batch."""
    held: list[tuple] = []

    def result(found):
        return pa.RecordBatch.from_pydict(
            {
                "node": pa.array([f[0] for f in found], pa.int64()),
                "links": pa.array([f[1] for f in found], pa.int64()),
                "low": pa.array([f[2] for f in found], pa.int64()),
            }
        )

    for batch in batches:
        found = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if held and held[-1][8] != row[8]:
                found += _tile(held, cosine) if len(held) > 1 else []
                held = []
            held.append(row)
        yield result(found)
    if len(held) > 1:
        yield result(_tile(held, cosine))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding,
    label)."""
    rows = doubles(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    able = usable() & F.col("label").isNotNull()
    rows = rows.select(
        "vec_id",
        F.col("label").cast("string").alias("label"),
        F.when(able, F.col("embedding")).alias("embedding"),
        F.when(able, F.xxhash64("label", "embedding")).alias("node"),
        F.xxhash64("embedding", "label").alias("proof"),
    )
    nodes = stored(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
            F.count("*").alias("copies"),
            F.min("proof").alias("p"),
            F.max("proof").alias("p2"),
        ),
        "vectors",
    )
    if not nodes.where("p <> p2").isEmpty():
        raise ValueError("two different vectors have the same 64-bit id")
    hits = nodes.select("label", "node", "copies", "embedding").repartition(shuffle_partitions(vectors.sparkSession)).mapInArrow(_filter_rows, _HITS)
    hits = stored(hits, "filters")
    cells = hits.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1")
    parts = F.ceil(F.col("k") / TILE)
    split = (
        hits.join(cells, "cell")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(
            "cell", "filter", "node", "copies", "x", "filters", F.col("part").alias("side"),
            (F.col("part") != F.col("other")).alias("across"),
            F.concat_ws(":", "cell", F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        )
    )
    found = stored(
        split.repartition(4 * shuffle_partitions(vectors.sparkSession), "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(lambda b: _tiles(b, cosine), "node long, links long, low long"),
        "tile-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    nodes = nodes.select("node", "copies").join(links, "node", "left").join(labels, "node", "left")
    nodes = nodes.select(
        "node",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("label", "node").alias("group"),
    )
    members = rows.select("vec_id", "node").join(nodes, "node", "left")
    group = F.struct(F.col("node").isNotNull().alias("linked"), F.coalesce("group", "vec_id").alias("group"))
    members = members.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), group.alias("group"))
    first = members.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    joined = members.join(first, members["group"].eqNullSafe(first["group"]))
    return joined.select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
