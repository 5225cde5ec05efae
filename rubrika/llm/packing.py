"""Packing token ids into fixed windows with a bounded number of open ones.

Each task keeps at most ``OPEN`` open windows. Whole windows are cut off long documents; what
remains goes whole into the open window that it fills best. When none has room, the fullest window
is emitted; if its gap is over ``SLACK`` ids, the head of the piece fills it first. The open windows
left by the tasks are merged: groups of tasks hand their windows to one task, which packs their
pieces again in the same way, until one group is left. A task then sees ``OPEN * FAN_IN`` windows
at most, whatever the input.

Cases: a null text is an empty text and still has its end id; null and repeated ids are kept row
by row; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import stored
from rubrika.llm.tokenizing import BYTE_LEVEL, encode_column

LENGTH = 2048
END_ID = 1
OPEN = 64
SLACK = 32
FAN_IN = 64
BATCH_BYTES = 8 << 20
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, origin long, closed boolean"
)
_TYPES = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.bool_()]
_NAMES = [field.split()[0] for field in PIECES.split(", ")]


class Windows:
    """Open windows of one task: ``fills`` sorted by fill, ``held`` their pieces."""

    def __init__(self, length: int, first_id: int):
        self.length, self.next = length, first_id
        self.fills: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}

    def _put(self, window: int, fill: int, piece: tuple) -> None:
        self.held[window].append((*piece, fill))
        insort(self.fills, (fill + len(piece[3]) // 4, window))

    def _close(self, at: int) -> Iterator[tuple[int, list[tuple]]]:
        _, window = self.fills.pop(at)
        yield window, self.held.pop(window)

    def add(self, doc_id, start: int, total: int, ids: bytes) -> Iterator[tuple[int, list[tuple]]]:
        """Place ids of a document; yields the windows that this closes."""
        size = self.length * 4
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            yield self._new(), [(doc_id, start + at // 4, total, ids[at : at + size], 0)]
        ids, start = ids[whole:], start + whole // 4
        while ids:
            n = len(ids) // 4
            # The fullest window with room: the last of those filled up to length - n.
            at = bisect_left(self.fills, (self.length - n + 1, -1)) - 1
            if at >= 0:
                fill, window = self.fills.pop(at)
                self._put(window, fill, (doc_id, start, total, ids))
                if fill + n == self.length:
                    yield from self._close(self.fills.index((self.length, window)))
                return
            if len(self.fills) < OPEN:
                window = self._new()
                self.held[window] = []
                self._put(window, 0, (doc_id, start, total, ids))
                return
            gap = self.length - self.fills[-1][0]
            if gap > SLACK:
                fill, window = self.fills.pop()
                self._put(window, fill, (doc_id, start, total, ids[: 4 * gap]))
                ids, start = ids[4 * gap :], start + gap
            yield from self._close(len(self.fills) - 1)

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        while self.fills:
            yield from self._close(len(self.fills) - 1)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1


def _rows(windows, origin: int, closed: bool) -> Iterator[tuple]:
    for window, pieces in windows:
        for doc_id, start, total, ids, offset in pieces:
            yield doc_id, start, len(ids) // 4, total, window, offset, ids, origin, closed


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6]) + 64
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _pack_task(batches, length: int, level: int, items) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    windows = Windows(length, (level << 56) | (task << 32))

    def rows():
        for batch in batches:
            for doc_id, start, total, ids in items(batch):
                yield from _rows(windows.add(doc_id, start, total, ids), task, True)
        yield from _rows(windows.rest(), task, False)

    yield from _batches(rows())


def _documents(tokenizer: str):
    end = END_ID.to_bytes(4, "little")

    def items(batch):
        for doc_id, raw in zip(batch.column(0).to_pylist(), encode_column(tokenizer, batch.column(1))):
            yield doc_id, 0, len(raw) // 4 + 1, raw + end

    return items


def _leftovers(batch):
    """Pieces of the windows that earlier tasks left open, long ones first."""
    columns = [batch.column(i).to_pylist() for i in range(4)]
    yield from sorted(zip(*columns), key=lambda x: -len(x[3]))


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = BYTE_LEVEL) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ids ``start`` to ``start + length`` of a document stand
    at ``offset`` of sequence ``sequence_id``. Each id of each document is in one piece."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = source.mapInArrow(
        lambda batches: _pack_task(batches, length, 1, _documents(tokenizer)), PIECES
    )
    pieces = stored(tasks, "packed")
    done = pieces.where("closed")
    left = pieces.where("not closed")
    groups, level = _groups(left), 2
    while True:
        merged = (
            left.select("doc_id", "start", "doc_tokens", "ids", (F.col("origin") / FAN_IN).cast("int").alias("g"))
            .repartition(groups, "g")
            .sortWithinPartitions("g", "doc_id", "start")
            .select("doc_id", "start", "doc_tokens", "ids")
            .mapInArrow(lambda b, level=level: _pack_task(b, length, level, _leftovers), PIECES)
        )
        if groups <= 1:
            return done.unionByName(merged).drop("origin", "closed")
        merged = stored(merged, "merged")
        done = done.unionByName(merged.where("closed"))
        left = merged.where("not closed")
        groups, level = _groups(left), level + 1


def _groups(left: DataFrame) -> int:
    """Groups of tasks that left windows open, from the largest task number."""
    last = left.agg(F.max("origin")).head()[0]
    return 1 if last is None else last // FAN_IN + 1
