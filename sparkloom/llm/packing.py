"""Bounded-space online packing of token sequences.

Each partition streams its documents through a fixed number of open windows of ``capacity`` tokens: a piece goes to the
window it fills best; when none has room, the fullest is topped up with the head of the piece (unless its gap is under
``MIN_PIECE``, which is then padding) and emitted. What exceeds the capacity is cut into full windows at once. Leftover
windows of a partition are few; they are merged in rounds of ``FAN_IN`` partitions by the same packer, and the last round
holds a single window, so that at most one sequence ends up with a large gap.

Ids are kept only where asked for; a row of about 60 bytes stands for a piece otherwise.

Texts are encoded in slices of about 1 MB, so that a task holds one slice, its open windows and tables of bounded bytes; a
very long text is one slice of its own.

Defined cases: a null or empty text is a document of the end id alone; equal rows are packed one by one; null ids, and ids
that are no whole numbers, are kept as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import input_partitions, long_id, slices, small_batches, stage, utf8
from ._word_ids import word_ids

CAPACITY = 2048
WINDOWS = 32
MIN_PIECE = 16
FAN_IN = 32
END_ID = 1

Piece = tuple[int | None, int, int, np.ndarray]
"""doc_id, start, tokens of the document, ids."""

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("origin", pa.int64()), ("left", pa.binary()),
])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, origin long, left binary"


class Packer:
    """Open windows of one partition. ``close`` is called with the pieces of each window that is done."""

    def __init__(self, close: Callable[[list[Piece]], None], capacity: int = CAPACITY, windows: int = WINDOWS, min_piece: int = MIN_PIECE):
        self.close, self.capacity, self.windows, self.min_piece = close, capacity, windows, min_piece
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        self.open: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        doc, start, tokens, ids = piece
        while len(ids):
            if len(ids) >= self.capacity:
                self.close([(doc, start, tokens, ids[: self.capacity])])
                start, ids = start + self.capacity, ids[self.capacity :]
                continue
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
                self._put(window, gap, (doc, start, tokens, ids))
                return
            if len(self.open) < self.windows:
                self.made += 1
                self.open[self.made] = []
                self._put(self.made, self.capacity, (doc, start, tokens, ids))
                return
            gap, window = self.gaps.pop(0)
            if gap < self.min_piece:
                self.close(self.open.pop(window))
                continue
            self._put(window, gap, (doc, start, tokens, ids[:gap]))
            start, ids = start + gap, ids[gap:]

    def _put(self, window: int, gap: int, piece: Piece) -> None:
        self.open[window].append(piece)
        if gap == len(piece[3]):
            self.close(self.open.pop(window))
        else:
            insort(self.gaps, (gap - len(piece[3]), window))

    def leftovers(self) -> list[list[Piece]]:
        return list(self.open.values())


class _Rows:
    """Gathers closed windows as output rows."""

    def __init__(self, first_id: int, with_ids: bool):
        self.next, self.with_ids = first_id, with_ids
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in range(8)]

    def __call__(self, window: list[Piece]) -> None:
        offset = 0
        for doc, start, tokens, ids in window:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
            for column, value in zip(self.columns, (doc, start, len(ids), crc, tokens, self.next, offset, ids.astype(np.int32) if self.with_ids else None), strict=True):
                column.append(value)
            offset += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, t.type) for c, t in zip(self.columns, _OUT, strict=False)]
        n = len(self.columns[0])
        out = pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_OUT)
        self.clear()
        return out


def _left_row(origin: int, windows: list[list[Piece]]) -> pa.RecordBatch:
    blob = zlib.compress(pickle.dumps([p for w in windows for p in w], protocol=5), 1)
    columns = [pa.nulls(1, f.type) for f in _OUT]
    columns[-2:] = [pa.array([origin], pa.int64()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _pack_partition(tokenizer: str, end_id: int, capacity: int, windows: int, with_ids: bool, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = _Rows(part << 28, with_ids)
        packer = Packer(rows, capacity, windows)
        encoder = word_ids(tokenizer, special)
        for batch in batches:
            for part_ in slices(batch, 1):
                ids, bounds = encoder.encode(utf8(part_.column(1)))
                for i, doc in enumerate(part_.column(0).to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    packer.add((doc, 0, len(own), own))
                yield rows.batch()
        yield rows.batch()
        if packer.open:
            yield _left_row(part, packer.leftovers())

    return run


def _merge_leftovers(level: int, capacity: int, windows: int, with_ids: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = _Rows((level << 56) | (group << 28), with_ids)
        packer = Packer(rows, capacity, windows, MIN_PIECE if windows > 1 else 1)
        pieces: list[Piece] = []
        for origin, blob in sorted(zip(table["origin"].to_pylist(), table["left"].to_pylist(), strict=True)):
            pieces += pickle.loads(zlib.decompress(blob))
        for piece in sorted(pieces, key=lambda p: -len(p[3])):
            packer.add(piece)
        if windows == 1:
            for window in packer.leftovers():
                rows(window)
            return pa.Table.from_batches([rows.batch()])
        return pa.Table.from_batches([rows.batch(), _left_row(group, packer.leftovers())] if packer.open else [rows.batch()])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = WINDOWS, end_id: int = END_ID, with_ids: bool = False, special: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``special``: literals of added tokens in the texts give those tokens' ids, as is the library's default; else they are
    text like any other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = input_partitions(docs)
    rows = docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"])
    done = stage(rows.mapInArrow(_pack_partition(tokenizer, end_id, capacity, windows, with_ids, special), _DDL), "packed")
    result, level, left = [done.where("left is null")], 0, done.where("left is not null").select("origin", "left")
    while True:
        level, parts = level + 1, -(-parts // FAN_IN)
        held = 1 if parts == 1 else windows
        grouped = left.withColumn("origin", F.floor(F.col("origin") / FAN_IN).cast("long"))
        merged = grouped.groupBy("origin").applyInArrow(_merge_leftovers(level, capacity, held, with_ids), _DDL)
        merged = stage(merged, "packed-leftovers")
        result.append(merged.where("left is null"))
        if parts == 1:
            break
        left = merged.where("left is not null").select("origin", "left")
    out = result[0]
    for more in result[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
