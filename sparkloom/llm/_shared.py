"""What the operators share: staging tables in the cluster's shared folder, and vectorised access to UTF-8 columns.

Work on text is done on Arrow buffers with numpy, a batch of documents at a time; no function here loops over characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import scratch_path, scratch_root, stage

__all__ = [
    "Utf8", "Words", "fresh", "give_back", "input_partitions", "long_id", "released", "remove", "scratch_path", "scratch_root", "slices", "small_batches", "spread", "stage", "tokenizer_path",
    "unsigned_crc32", "utf8", "without", "words",
]

#: Bytes of text that numpy works on at once; its arrays take some thirty times as much.
SLICE_BYTES = 1 << 20
#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches handed to Python, which hold whole texts, and makes this package known to the workers.

    The two settings are the session's, and lowered only where they are larger.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2048), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later; workers are reused, and so is what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files when the query ends; for queries that end in a written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table's folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes in the column ``text``; a row is never cut. Memory is given back after each batch."""
    ends = np.cumsum(np.diff(utf8(batch.column(text)).offsets))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size)))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def input_partitions(df: DataFrame) -> int:
    """How many tasks read ``df``; sets shard counts in proportion to the input."""
    return max(1, df.rdd.getNumPartitions())


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that is none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def long_id(column: Column) -> Column:
    """Ids as longs. Those that are no whole numbers are null, as documents without an id are."""
    return column.try_cast("long")


def without(docs: DataFrame, id_column: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in ``gone`` (one column, staged). Few ids go to the rows; many meet them by shuffle."""
    name = fresh(docs, "gone_id")
    few = gone.count() <= BROADCAST_IDS
    gone = gone.toDF(name)
    return docs.join(F.broadcast(gone) if few else gone, long_id(docs[id_column]) == gone[name], "left_anti")


def tokenizer_path(name: str) -> str:
    """Where this machine has the file ``name``: as it stands where it is a path, else that of a public tokenizer."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Utf8:
    """A string column as one byte buffer; document i is ``data[offsets[i]:offsets[i + 1]]``. Nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def utf8(column: pa.Array) -> Utf8:
    if pa.types.is_string_view(column.type) or pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Utf8(bytes_, offsets - offsets[0], valid)


#: Bytes 0x20 and 0x09 to 0x0D part words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of a batch. ``joined`` holds them parted by single spaces; word i is ``joined[start[i]:end[i]]``.

    ``bounds[d]:bounds[d + 1]`` are the words of document d; ``source`` is where each word starts in the batch's bytes.
    """

    joined: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    source: np.ndarray


def words(text: Utf8) -> Words:
    inside = ~_SPACE[text.data]
    filled = text.offsets[:-1][np.diff(text.offsets) > 0]
    closing = text.offsets[1:][np.diff(text.offsets) > 0] - 1
    opens, closes = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        opens[0], opens[1:] = True, ~inside[:-1]
        closes[-1], closes[:-1] = True, ~inside[1:]
    opens[filled], closes[closing] = True, True
    first, last = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    length = last - first
    end = np.cumsum(length + 1) - 1 if len(length) else np.zeros(0, np.int64)
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    if len(length):
        joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = text.data[inside]
    return Words(joined, end - length, end, np.searchsorted(first, text.offsets), first)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def unsigned_crc32(column: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as a non-negative long."""
    return F.crc32(column.cast("binary"))
