"""Runs of bytes as tokens, and batches of documents gathered into pieces of a stated size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._shared import Utf8, utf8

#: Lower case for A-Z alone; bytes of longer code points stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def runs(text: Utf8, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes that ``inside`` (one flag for each byte value) holds true, folded, and the document of each."""
    kept = inside[text.data]
    opens, closes = kept.copy(), kept.copy()
    opens[1:] &= ~kept[:-1]
    closes[:-1] &= ~kept[1:]
    filled = np.diff(text.offsets) > 0
    edge, last = text.offsets[:-1][filled], text.offsets[1:][filled] - 1
    opens[edge], closes[last] = kept[edge], kept[last]
    first = np.flatnonzero(opens)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(closes) + 1 - first)))
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(FOLD[text.data[kept]]))
    return found, np.searchsorted(text.offsets, first, side="right") - 1


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int, most_docs: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole rows, of about ``most_bytes`` in the column ``text``. A row is never cut."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for batch in batches:
        ends = np.cumsum(np.diff(utf8(batch.column(batch.schema.get_field_index("text"))).offsets))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(batch.num_rows, at + most_docs - docs, int(np.searchsorted(ends, before + most_bytes - size)) + 1)
            held.append(batch.slice(at, to - at))
            docs, size, at = docs + to - at, size + int(ends[to - 1]) - before, to
            if docs >= most_docs or size >= most_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, docs, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
