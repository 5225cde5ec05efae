"""Size-aware heavy-light join: which documents share most of their word shingles.

Sets of five-word shingles link when 100 * |intersection| >= 75 * |union|. A pair of sizes n and m
then shares at least ``overlap(n, m)`` shingles.

* Light sets, up to the boundary: every subset of ``overlap(n, m)`` shingles is enumerated for each
  partner size m, and two sets that share one are linked; nothing is left to verify.
* Heavy sets: inverted lists. In one order of all shingles, rare ones first, a set can only link
  with sets that share one of its first n - ceil(0.75 n) + 1 shingles, so only these are posted, and
  every list with two or more sets is scanned. The later a shingle stands in a set, the smaller the
  partners it can link with: at place p (from 0) of a set of n the partner has at most
  ``reach`` = (4 n - 7 p) / 3 shingles. A pair meets in a list only where each size is within the
  other's reach. Pairs are verified on the whole sets.

The boundary is the size at which the rows of both ways together are fewest, from the counts of set
sizes. Light sets that may link with heavy ones are posted as well.

Equal sets are one node from the start. A list of k sets that are all alike would give k * k pairs,
so nodes are first linked with one leader each, the set that leads most of their lists: the smallest
node of a list at first, then the one that meets most others. After that, lists are scanned in full,
short ones first (they hold the changes that copies of a changed copy share), then all, but only for
pairs in different components, since a pair in one component cannot change the result. No link
between different components is lost.

In the lists that are scanned in full, each posting has its set's sketch: for each of 512 residues of
the hashes whether it has an odd number of them. Every shingle that only one side has turns one bit, so
sketches that differ in d bits belong to sets with d or more such shingles, and sets that link have at
most a seventh of both sizes. So a pair that d refuses is no link, and never a row. Long sets would fill
such a sketch, so sets of 900 shingles or more are posted as 32 parts, by classes of hashes: of sets that
link, the parts of at least one class do too (else more than a seventh would differ in all), and these
meet in a list of that class. Each part has prefix, reach and sketch of its own. Sets of 675 to 1,200 may link with
either kind: up to 1,200 they are posted whole, from 900 on by parts.

Before whole sets travel, many candidate pairs meet by signatures: a bit per residue of a set's hashes,
two to four bits a shingle. A bit that only one side has stands for a shingle that the other lacks, so
the bits bound the intersection from above, and pairs bounded below ``overlap`` are refused. That refuses
no link; what is left is counted on the sets.

Shingles have 64-bit hashes, cut to 48 bits for counting overlaps (a false match within a pair of
documents of 1,000 words has a chance of 4e-9). Nodes have 64-bit ids checked by a second hash: a
clash stops the query.

Cases: null, empty and blank texts have an empty set, link with nothing and are their own component;
with fewer than five words the whole sequence is one shingle; null ids are kept, take part, and
never name a component (it is null where no member has an id); rows that repeat an id are documents
of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import collect_garbage, release, shuffle_partitions, slices, stored, utf8
from rubrika.llm.components import components
from rubrika.llm.words import find, hashes, mix, shingles

WORDS = 5
CHUNK_BYTES = 1 << 20
SKETCH_BITS = 20
SEGMENTS = 64
LIGHT_LIMIT = 24  # light sets have at most so many shingles, whatever the costs
VERIFY_COST = 4  # rows that a posting costs beside itself
FILTER_BITS = 24
CENTRE_ROUNDS = 1
SHORT = 64  # lists up to this length are scanned in full before the longer ones
HUB_PAIRS = 2000
MOVED = 0.5
BATCH_ROWS = 512
BROADCAST_PAIRS = 1_000_000  # pairs of nodes up to this many (40 bytes each) may be broadcast
LONG = 900  # sets from so many shingles on are posted by parts
CLASSES = 32
WHOLE = -1
OF_PARTS = np.uint64(1 << 46)
SKETCH = tuple(f"s{i}" for i in range(8))  # a sketch of 64 bits each
SETS = "doc_id long, n long, node long, proof long, sig binary, elems binary"


def overlap(n: int, m: int) -> int:
    """Fewest common shingles of linked sets of these sizes: ceil(3 (n + m) / 7)."""
    return -(-3 * (n + m) // 7)


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def reaches(n: int) -> np.ndarray:
    """For each posted place of a set of n the largest partner whose first shared shingle may stand
    there: overlap(n, m) <= n - p."""
    return (4 * n - 7 * np.arange(prefix_size(n))) // 3


REACH = "n_a <= reach_b AND n_b <= reach_a"
# Linked sets have at most (n_a + n_b) / 7 shingles that the other lacks.
ALIKE = f"7 * ({' + '.join(f'bit_count({s}_a ^ {s}_b)' for s in SKETCH)}) <= n_a + n_b"


def _document_shingles(batch_column):
    """Shingle hashes of each text of a column, document by document."""
    data, offsets = utf8(batch_column)
    for i, j in slices(offsets, CHUNK_BYTES):
        part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, counts = find(part, cut)
        words = hashes(part, starts, ends)
        at = np.concatenate(([0], np.cumsum(counts)))
        for k in range(j - i):
            yield shingles(words[at[k] : at[k + 1]], WORDS)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _sketch_task(batches):
    """Shingles per bucket of hashes, over one task's documents."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    held, size = [], 0
    for batch in batches:
        for h in _document_shingles(batch.column(0)):
            held.append(h)
            size += len(h)
            if size > 1 << 20:
                total += np.bincount(_bucket(_short(np.concatenate(held))), minlength=len(total))
                held, size = [], 0
    if held:
        total += np.bincount(_bucket(_short(np.concatenate(held))), minlength=len(total))
    yield pa.RecordBatch.from_pydict(
        {
            "segment": pa.array(range(SEGMENTS), pa.int32()),
            "part": pa.array(np.random.default_rng(int(total.sum())).integers(0, 64, SEGMENTS), pa.int32()),
            "counts": [x.tobytes() for x in np.split(total, SEGMENTS)],
        }
    )


def _sum_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SEGMENTS, np.int64)
    for raw in group["counts"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"segment": [group["segment"].iloc[0]], "counts": [total.tobytes()]})


def common_levels(docs: DataFrame) -> np.ndarray:
    """A level for each of 2^20 buckets of shingles: 0 unless the bucket has eight times the mean,
    else the binary logarithm of its excess. Counts cover all shingles; the result has one MB."""
    schema = "segment int, counts binary"
    parts = docs.select("text").mapInArrow(_sketch_task, "segment int, part int, counts binary")
    parts = parts.groupBy("segment", "part").applyInPandas(_sum_counts, schema)
    rows = parts.groupBy("segment").applyInPandas(_sum_counts, schema).collect()
    counts = np.zeros(1 << SKETCH_BITS)
    width = len(counts) // SEGMENTS
    for row in rows:
        counts[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    excess = counts / max(counts.mean(), 1.0)
    return np.where(excess >= 8, np.log2(np.maximum(excess, 1)), 0).astype(np.int8)


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def signature_width(n: np.ndarray) -> np.ndarray:
    """Bits in the signature of a set of n: the power of two from 2 n on, at least 64."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def _signature(h: np.ndarray) -> bytes:
    bits = np.zeros(int(signature_width(np.array([len(h)]))[0]), np.uint8)
    bits[h & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _set_rows(batches, levels, carry):
    table = levels.value
    for batch in batches:
        sizes, nodes, proofs, sigs, elems = [], [], [], [], []
        for h in _document_shingles(batch.column(1)):
            h = np.unique(h)
            sizes.append(len(h))
            nodes.append(int(mix(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0]))
            proofs.append(int(mix(h).sum(dtype=np.uint64).view(np.int64)))
            h = _short(h)
            sigs.append(_signature(h))
            elems.append(_pack(h[np.argsort(table[_bucket(h)], kind="stable")]))
        columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64())]
        passed = [batch.column(2 + k) for k in range(len(carry))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(sigs, pa.binary()), pa.array(elems, pa.binary()), *passed],
            names=["doc_id", "n", "node", "proof", "sig", "elems", *carry],
        )


def shingle_sets(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, node, proof, sig, elems``: the set of each document in the common order, rare
    shingles first, and its signature; equal sets have the same node. ``carry`` names columns of whole numbers to pass on."""
    passed = [F.col(name).cast("long").alias(name) for name in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *passed)
    levels = docs.sparkSession.sparkContext.broadcast(common_levels(docs))
    schema = ", ".join([SETS, *[f"{name} long" for name in carry]])
    return docs.mapInArrow(lambda batches: _set_rows(batches, levels, carry), schema)


def light_boundary(sizes: dict[int, int]) -> int:
    """The largest light size that makes subsets and postings together fewest."""

    def subsets(n: int, x: int) -> int:
        return sum(comb(n, overlap(n, m)) for m in range((3 * n + 3) // 4, min(x, 4 * n // 3) + 1))

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * subsets(n, x)
            if 4 * n >= 3 * (x + 1):
                total += count * prefix_size(n) * (1 + VERIFY_COST)
        return total

    return min(range(LIGHT_LIMIT + 1), key=lambda x: (cost(x), x))


def _subset_rows(batches, boundary: int):
    for batch in batches:
        keys, nodes, sides = [], [], []
        for node, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = np.sort(_unpack(raw))
            for m in range((3 * n + 3) // 4, min(boundary, 4 * n // 3) + 1):
                c = overlap(n, m)
                if c > n:
                    continue
                rows = np.array(list(combinations(range(n), c)))
                total = np.full(len(rows), min(n, m) << 8 | max(n, m), np.uint64)
                for k in range(c):
                    total = mix(total + h[rows[:, k]])
                keys += total.view(np.int64).tolist()
                nodes += [node] * len(rows)
                sides += [(n > m) - (n < m)] * len(rows)
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(keys, pa.int64()), "node": pa.array(nodes, pa.int64()), "side": pa.array(sides, pa.int32())}
        )


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) among light sets: each member of a subset's list with the first member of the
    other size, or of its own where both sizes are equal."""
    small = sets.where(F.col("n").between(1, boundary)).groupBy("node").agg(F.first("n").alias("n"), F.first("elems").alias("elems"))
    rows = small.mapInArrow(lambda b: _subset_rows(b, boundary), "key long, node long, side int")
    first = rows.groupBy("key").agg(
        F.min(F.when(F.col("side") <= 0, F.col("node"))).alias("low"),
        F.min(F.when(F.col("side") >= 0, F.col("node"))).alias("high"),
    )
    pairs = rows.join(first.where("low IS NOT NULL AND high IS NOT NULL"), "key")
    other = F.when(F.col("side") < 0, F.col("high")).otherwise(F.col("low"))
    return pairs.select(F.col("node").alias("a"), other.alias("b")).where("a <> b").distinct()


def parts(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """What a set is posted by: itself (``WHOLE``) up to 4/3 of ``LONG``, and from ``LONG`` on its parts by
    class of hashes. Sets that link are both posted in one of these ways."""
    found = [(WHOLE, h)] if 3 * len(h) <= 4 * LONG else []
    if len(h) >= LONG:
        kind = (mix(h) >> np.uint64(32)) % np.uint64(CLASSES)
        found += [(c, h[kind == c]) for c in range(CLASSES)]
    return [(c, part) for c, part in found if len(part)]


def sketch(h: np.ndarray) -> np.ndarray:
    """A bit per residue of the hashes: whether an odd number of them has it."""
    width = 64 * len(SKETCH)
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_rows(batches, least: int):
    for batch in batches:
        nodes, kinds, words = [], [], []
        for n, node, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for kind, part in parts(_unpack(raw)) if n >= least else []:
                nodes.append(node)
                kinds.append(kind)
                words.append(sketch(part))
        words = np.array(words, np.int64).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()), *(pa.array(w) for w in words.T.copy())],
            names=["node", "class", *SKETCH],
        )


def sketches(sets: DataFrame, boundary: int) -> DataFrame:
    """``node, class`` and the columns ``SKETCH`` of all that ``shared_lists`` posts."""
    schema = ", ".join(["node long, class int", *[f"{s} long" for s in SKETCH]])
    least = least_posted(boundary)
    rows = sets.select("n", "node", "elems").mapInArrow(lambda b: _sketch_rows(b, least), schema)
    return rows.dropDuplicates(["node", "class"])


def least_posted(boundary: int) -> int:
    return max(1, -(-3 * (boundary + 1) // 4))


def _posting_rows(batches, least: int, buckets: int):
    """First shingles of the sets of size ``least`` or more, or of their parts, packed by bucket."""
    for batch in batches:
        sizes, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.flatnonzero(sizes >= least)
        if not len(keep):
            continue
        column = batch.column(2)
        posts = [(nodes[k], c, len(x), x[: prefix_size(len(x))]) for k in keep for c, x in parts(_unpack(column[int(k)].as_py()))]
        # Parts have lists of their own, apart from those of whole sets.
        h = np.concatenate([x if c == WHOLE else x ^ OF_PARTS for _, c, _, x in posts])
        posted = [len(x) for *_, x in posts]
        owner = np.repeat(np.array([node for node, *_ in posts], np.int64), posted)
        kind = np.repeat(np.array([c for _, c, *_ in posts], np.int8), posted)
        size = np.repeat(np.array([n for _, _, n, _ in posts], np.int32), posted)
        reach = np.concatenate([reaches(n) for _, _, n, _ in posts]).astype(np.int32)
        place = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        h, owner, kind, place, size, reach = (x[order] for x in (h, owner, kind, place, size, reach))
        cut = np.searchsorted(place, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(full, pa.int32()),
                "h": [_pack(h[cut[k] : cut[k + 1]]) for k in full],
                "nodes": [owner[cut[k] : cut[k + 1]].tobytes() for k in full],
                "classes": [kind[cut[k] : cut[k + 1]].tobytes() for k in full],
                "sizes": [size[cut[k] : cut[k + 1]].tobytes() for k in full],
                "reaches": [reach[cut[k] : cut[k + 1]].tobytes() for k in full],
            }
        )


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _shared_lists(group: pd.DataFrame) -> pd.DataFrame:
    """Postings of the lists that have two or more nodes, without those that reach no other."""
    rows = pd.DataFrame(
        {
            "h": np.concatenate([_unpack(x) for x in group["h"]]).astype(np.int64),
            "node": _joined(group["nodes"], np.int64),
            "class": _joined(group["classes"], np.int8).astype(np.int32),
            "n": _joined(group["sizes"], np.int32),
            "reach": _joined(group["reaches"], np.int32),
        }
    )
    rows = rows[rows.duplicated("h", keep=False)].drop_duplicates(["h", "node"])
    least = rows.groupby("h")["n"].transform("min")
    rows = rows[rows["reach"] >= least]
    rows = rows[rows.duplicated("h", keep=False)].sort_values(["h", "node"], kind="stable")
    lead = rows.groupby("h")[["node", "n", "reach"]].transform("first")
    return rows.assign(leader=lead["node"], n_leader=lead["n"], reach_leader=lead["reach"])


LISTS = "h long, node long, class int, n int, reach int, leader long, n_leader int, reach_leader int"


def shared_lists(sets: DataFrame, boundary: int) -> DataFrame:
    """Inverted lists over the first shingles of heavy sets, and of light ones that may link with
    them, without the lists of one node; the leader is the smallest node of its list. ``n`` and ``reach``
    are those of what is posted, the set or a part. They travel packed: 23 bytes a posting."""
    buckets = 4 * shuffle_partitions(sets.sparkSession)
    least = least_posted(boundary)
    packed = sets.select("n", "node", "elems").mapInArrow(
        lambda b: _posting_rows(b, least, buckets),
        "bucket int, h binary, nodes binary, classes binary, sizes binary, reaches binary",
    )
    return packed.groupBy("bucket").applyInPandas(_shared_lists, LISTS)


def _among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, elems`` of the sets whose node is among ``nodes`` (and a few others), of each task a node
    once. A bit map of 2^24 hashed nodes (2 MB, whatever the input) picks them where they are read."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    words = (
        nodes.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / 32).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 AS int)))").alias("bits"))
        .toPandas()
    )
    bits = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def known(batches):
        seen: set[int] = set()
        for batch in batches:
            p = batch.column(3).to_numpy()
            hit = (shared.value[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            node = batch.column(0).to_numpy()
            for k in np.flatnonzero(hit):
                hit[k] = int(node[k]) not in seen
                seen.add(int(node[k]))
            yield batch.filter(pa.array(hit)).select([0, 1, 2])

    return sets.select("node", "n", "elems", place.alias("p")).mapInArrow(known, "node long, n long, elems binary")


def _possible(batches):
    """The pairs of rows a, b, n_a, e_a, n_b, e_b whose signatures ``e`` allow a link."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in (2, 4))
        (raw_a, at_a), (raw_b, at_b) = (_bytes(batch.column(c)) for c in (3, 5))
        width_a, width_b = np.diff(at_a), np.diff(at_b)
        keep = np.ones(len(n), bool)
        for wa, wb in set(zip(width_a.tolist(), width_b.tolist())):
            rows = np.flatnonzero((width_a == wa) & (width_b == wb))
            step = max(1, CHUNK_BYTES // max(wa, wb))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                left = _folded(raw_a, at_a[some], wa, min(wa, wb))
                right = _folded(raw_b, at_b[some], wb, min(wa, wb))
                only_a = np.bitwise_count(left & ~right).sum(1, dtype=np.int64)
                only_b = np.bitwise_count(right & ~left).sum(1, dtype=np.int64)
                both = np.minimum(n[some] - only_a, m[some] - only_b)
                keep[some] = 100 * both >= 75 * (n[some] + m[some] - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), at


def _folded(raw: np.ndarray, starts: np.ndarray, width: int, to: int) -> np.ndarray:
    """Signatures of ``width`` bytes as words, cut to ``to`` bytes: a residue there is one here too."""
    found = raw[starts[:, None] + np.arange(width)].view(np.uint64)
    found = found.reshape(len(starts), width // to, to // 8)
    return np.bitwise_or.reduce(found, axis=1)


def _linked(batches):
    """The pairs (a, b) of rows a, b, n_a, e_a, n_b, e_b that link; one pair of sets is unpacked at a time."""
    for batch in batches:
        sizes = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
        keep = np.zeros(batch.num_rows, bool)
        for k, (n, m) in enumerate(sizes):
            left, right = (_unpack(batch.column(c)[k].as_py()) for c in (3, 5))
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep[k] = 100 * both >= 75 * (n + m - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


@contextmanager
def _small_batches(spark):
    """Rows that carry whole sets reach the Python workers ``BATCH_ROWS`` at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def verified(sets: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, counted on the whole sets, if there are many once the signatures allow
    it; ``nodes`` has ``node, n, sig``, each node once."""
    sizes = nodes.select("node", "n")
    if pairs.count() <= MOVED * sizes.count():
        return _at_hubs(sets, sizes, pairs, _linked, "links", 1.0)
    signed = nodes.select("node", "n", F.col("sig").alias("elems"))
    likely = _at_hubs(signed, sizes, pairs, _possible, "likely", 1 / 12)
    found = _at_hubs(sets, sizes, likely, _linked, "links", 1.0)
    release(likely)
    return found


def _at_hubs(sets: DataFrame, sizes: DataFrame, pairs: DataFrame, keep, purpose: str, weight: float) -> DataFrame:
    """The pairs that ``keep`` finds to hold for their two sets (or signatures) ``elems``, which take
    at most ``weight`` of the bytes of the sets.

    Of each pair the node with more pairs is the hub. The other's set goes to the hub, once a pair,
    from where it is read; the hub's set goes once, or once for each ``HUB_PAIRS`` pairs, among which
    the pairs are then dealt out. Where the sets on their way would be more than ``MOVED`` of all
    sets, pairs go in as many turns as keep below that, whatever the size of the input.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    of_a, of_b = (degree.select(F.col("node").alias(c), F.col("times").alias(f"times_{c}")) for c in "ab")
    first = F.col("times_a") >= F.col("times_b")
    parts = F.ceil(F.greatest("times_a", "times_b") / HUB_PAIRS).cast("int")
    spoke = F.when(first, F.col("b")).otherwise(F.col("a"))
    told = pairs.join(of_a, "a").join(of_b, "b").select(
        "a",
        "b",
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
        spoke.alias("node"),
        parts.alias("parts"),
        F.pmod(F.xxhash64(spoke), parts).cast("int").alias("part"),
    )
    told = stored(told.join(sizes, "node"), "told")
    moved, whole = (table.agg(F.sum("n")).first()[0] or 0 for table in (told, sizes))
    turns = max(1, math.ceil(weight * moved / (MOVED * max(whole, 1))))
    found = []
    for turn in range(turns):
        now = told.where(F.pmod(F.xxhash64("hub", "part", F.lit("turn")), F.lit(turns)) == turn)
        with _small_batches(sets.sparkSession):
            found.append(stored(_counted(sets, now.drop("n"), keep), purpose))
        collect_garbage(sets.sparkSession)
    release(told)
    together = reduce(DataFrame.union, found)
    together.stored_path = [part.stored_path for part in found]
    return together


def _counted(sets: DataFrame, told: DataFrame, keep) -> DataFrame:
    small = told.count() <= BROADCAST_PAIRS
    spokes = _among(sets, told.select("node"))
    spokes = spokes.join(F.broadcast(told) if small else told, "node")
    spokes = spokes.select("hub", "part", "a", "b", F.col("n").alias("n_a"), F.col("elems").alias("e_a"))
    copies = told.select(F.col("hub").alias("node"), "part").distinct()
    hubs = _among(sets, copies.select("node")).groupBy("node").agg(F.first("n").alias("n_b"), F.first("elems").alias("e_b"))
    hubs = hubs.join(F.broadcast(copies) if small else copies, "node")
    hubs = hubs.select(F.col("node").alias("hub"), "part", "n_b", "e_b")
    both = spokes.join(hubs, ["hub", "part"]).select("a", "b", "n_a", "e_a", "n_b", "e_b")
    return both.mapInArrow(keep, "a long, b long").distinct()


def _best_leaders(led: DataFrame) -> DataFrame:
    """Each node with the leader of most of its lists, where both are in reach."""
    led = led.where("node <> leader AND n <= reach_leader AND n_leader <= reach")
    by = led.groupBy("node", "leader").agg(F.count("*").alias("times"))
    best = by.groupBy("node").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    return best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _lead_across(lists: DataFrame, turn: int) -> DataFrame:
    """Mixed lists with their leaders; only nodes of other components count. The leader of a list
    is in the first turn the node that meets most others in all its lists, such as the text that a
    group was copied from, later the first in a new random order."""
    if turn == 0:
        weights = lists.groupBy("node").agg(F.sum("length").alias("weight"))
        ranked = lists.join(weights, "node")
    else:
        ranked = lists.withColumn("weight", F.xxhash64("node", F.lit(turn)))
    chosen = F.struct(
        F.col("node").alias("leader"),
        F.col("component").alias("its"),
        F.col("n").alias("n_leader"),
        F.col("reach").alias("reach_leader"),
    )
    top = ranked.groupBy("h").agg(F.max_by(chosen, F.struct("weight", "node")).alias("top"))
    return lists.join(top.select("h", "top.*"), "h").where("component <> its")


def remaining_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of different components that are in each other's reach in a common list and that their
    sketches allow."""
    columns = ("node", "component", "n", "reach", *SKETCH)
    left = lists.select("h", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = lists.select("h", *(F.col(c).alias(f"{c}_b") for c in columns))
    pairs = left.join(right, "h").where(f"node_a < node_b AND component_a <> component_b AND {REACH} AND {ALIKE}")
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def mixed_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``h, node, class, n, reach, component, length`` of the lists that hold more than one component; they
    take the place of ``lists``, which are released."""
    labels = components(links)
    names = labels.withColumnRenamed("label", "component")
    named = lists.select("h", "node", "class", "n", "reach").join(names, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("h").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length")
    )
    found = stored(named.join(mixed.where("lo <> hi").select("h", "length"), "h"), "mixed-lists")
    release(lists, labels)
    return found


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text). With ``carry`` also
    those columns of whole numbers, and ``group``, which names the component where no id does."""
    with _small_batches(docs.sparkSession):
        sets = stored(shingle_sets(docs, carry), "sets", "none")
    nodes = stored(
        sets.where("n > 0").groupBy("node").agg(
            F.min("n").alias("n"),
            F.max("n").alias("n2"),
            F.min("proof").alias("p"),
            F.max("proof").alias("p2"),
            F.first("sig").alias("sig"),
        ),
        "nodes",
    )
    if not nodes.where("n <> n2 OR p <> p2").isEmpty():
        raise ValueError("two different shingle sets have the same 64-bit id")
    sizes = nodes.select("node", "n")
    counts = sizes.where(F.col("n") <= 2 * LIGHT_LIMIT).groupBy("n").count().collect()
    boundary = light_boundary({row["n"]: row["count"] for row in counts})
    links = stored(light_links(sets, boundary), "light-links")

    def more(pairs: DataFrame) -> DataFrame:
        """All links with those among ``pairs``, each round a table of its own."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            release(pairs)
            return links
        found = verified(sets, nodes, pairs)
        release(pairs)
        return links.union(found)

    lists = stored(shared_lists(sets, boundary), "lists")
    links = more(_best_leaders(lists))
    for turn in range(CENTRE_ROUNDS):
        lists = mixed_lists(lists, links)
        links = more(_best_leaders(_lead_across(lists, turn)))
    drawn = stored(sketches(sets, boundary), "sketches")
    for longest in (SHORT, None):
        lists = mixed_lists(lists, links)
        scanned = lists if longest is None else lists.where(F.col("length") <= longest)
        links = more(remaining_pairs(scanned.join(drawn, ["node", "class"])))
    release(lists, nodes, drawn)
    labels = components(links)
    members = sets.select("doc_id", "n", "node", *carry).join(labels, "node", "left")
    group = F.struct(
        (F.col("n") > 0).alias("linked"),
        F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.coalesce("doc_id", "node")).alias("label"),
    )
    members = members.select("doc_id", "n", group.alias("group"), *carry)
    first = members.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    more = (*carry, "group") if carry else ()
    return members.join(first, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
