"""Chunks of whole documents that several passes visit, each time with keys that concern them.

``ChunkTable`` writes the documents once, in compressed chunks of about ``CHUNK_BYTES``, bucketed by chunk number, so that
later passes join them with per-chunk data without moving a text. Keys travel in sorted 64-bit blobs, one for each chunk
and key bucket: eight bytes a key, one row for many. A key that half of the corpus holds costs one entry a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Utf8, input_partitions, scratch_path, small_batches, utf8

CHUNK_BYTES = 6 << 20

Keys = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
Finish = Callable[[int, pa.RecordBatch, np.ndarray], pa.RecordBatch]


def pack_docs(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as writer:
        writer.write_table(docs)
    return sink.getvalue().to_pybytes()


def unpack_docs(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
    return table.to_batches()[0]


def _gather(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []
    size = made = 0

    def emit() -> pa.RecordBatch:
        nonlocal held, size, made
        row = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([pack_docs(pa.Table.from_batches(held))], pa.binary())], ["chunk", "docs"])
        held, size, made = [], 0, made + 1
        return row

    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(np.diff(utf8(text).offsets))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(batch.num_rows, int(np.searchsorted(ends, before + chunk_bytes - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= chunk_bytes:
                yield emit()
    if held:
        yield emit()


@dataclass
class ChunkTable:
    """``table`` has (chunk long, docs binary) in ``buckets`` buckets of chunk."""

    table: DataFrame
    buckets: int
    name: str

    @classmethod
    def write(cls, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> ChunkTable:
        """``docs`` needs a string column ``text``; its other columns are carried along."""
        spark = docs.sparkSession
        small_batches(spark)
        buckets = max(2 * input_partitions(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
        buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        name = f"sparkloom_chunks_{uuid.uuid4().hex}"
        rows = docs.mapInArrow(lambda batches: _gather(batches, chunk_bytes), "chunk long, docs binary")
        rows.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).option("compression", "none").saveAsTable(name)
        return cls(spark.table(name), buckets, name)

    def drop(self) -> None:
        """Forgets the table and deletes its files."""
        spark = self.table.sparkSession
        location = [r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {self.name}").collect() if r["col_name"] == "Location"][0]
        spark.sql(f"DROP TABLE {self.name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(location)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _with(self, side: DataFrame | None) -> DataFrame:
        """Chunks with the blobs that ``side`` (chunk, blob) has for them, as an array; never moves a chunk."""
        if side is None:
            return self.table.select("chunk", "docs", F.array().cast("array<binary>").alias("blobs"))
        gathered = side.repartition(self.buckets, "chunk").groupBy("chunk").agg(F.collect_list("blob").alias("blobs"))
        return self.table.join(gathered.hint("shuffle_merge"), "chunk", "left").select("chunk", "docs", "blobs")

    def keys(self, extract: Keys, side: DataFrame | None = None) -> DataFrame:
        """(bucket int, chunk long, blob binary): the sorted keys that ``extract`` finds in each chunk, by key bucket.

        Keys are longs, or records of which the field ``a`` is one.
        """
        buckets = self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, docs, blobs in _rows(batches):
                found = extract(docs, blobs)
                of = bucket_of(found["a"] if found.dtype.names else found, buckets)
                order = np.argsort(of, kind="stable")
                values, first = np.unique(of[order], return_index=True)
                parts = np.split(found[order], first[1:]) if len(values) else []
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array([chunk] * len(values), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "chunk", "blob"])

        return self._with(side).mapInArrow(run, "bucket int, chunk long, blob binary")

    def finish(self, apply: Finish, ddl: str, side: DataFrame | None = None) -> DataFrame:
        """Rows that ``apply`` makes of each chunk's documents and blobs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, docs, blobs in _rows(batches):
                yield apply(chunk, docs, blobs)

        return self._with(side).mapInArrow(run, ddl)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Chunk, its documents, and the bytes of all its blobs, one after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            blobs = batch.column(2)[i].values
            yield batch.column(0)[i].as_py(), unpack_docs(batch.column(1)[i].as_buffer()), utf8(blobs.cast(pa.large_binary())).data if blobs is not None else np.zeros(0, np.uint8)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def flagged(hashes: np.ndarray) -> np.ndarray:
    """Distinct 63-bit keys of 64-bit hashes, sorted, the lowest bit set where a hash occurs more than once."""
    values, counts = np.unique(hashes << np.uint64(1), return_counts=True)
    return (values | (counts > 1).astype(np.uint64)).view(np.int64)


def recurring(keys: DataFrame) -> DataFrame:
    """(chunk, blob): of flagged keys those that occur at least twice in all, for each chunk that has them."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["blob"]]
        every = np.concatenate(blobs)
        values, at, counts = np.unique(every >> np.uint64(1), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[at[(every & np.uint64(1)) == 1]] = True
        keep = twice[at]
        chunks, out, lo = [], [], 0
        for chunk, b in zip(table["chunk"].to_pylist(), blobs, strict=True):
            mine = b[keep[lo : lo + len(b)]] & ~np.uint64(1)
            lo += len(b)
            if len(mine):
                chunks.append(chunk)
                out.append(mine.tobytes())
        return pa.table([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "blob"])

    return keys.groupBy("bucket").applyInArrow(run, "chunk long, blob binary")


def joined_keys(blobs: np.ndarray) -> np.ndarray:
    """All keys of a chunk's blobs, sorted, as uint64."""
    return np.sort(np.ascontiguousarray(blobs).view(np.uint64))


def among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def text_of(docs: pa.RecordBatch) -> Utf8:
    return utf8(docs.column(docs.schema.get_field_index("text")))
