"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition ("leaf") turns its texts into a run of (digest, best row, count). Partitions then exchange runs in
binomial rounds of fan-in ``FAN_IN``: in round r a run's digests move to the partner whose r-th digit equals the digest's
r-th digit, and the partner merges what it gets as sorted streams, keeping one row a digest. After the last round each
digest lives in one place, having met every other leaf; a text that fills a third of the table costs one row a leaf.
Winners go back to the leaves that hold the digest, and only there meet the rows.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; two independent hashes of that
normal form (SHA-256 and a 64-bit hash) must agree at every merge. Of equal texts the row with the most code points in
its original text stays, then the smallest id, then the first row of repeated rows.

Defined cases: a null text counts as empty; ids that are no whole numbers are null, and null ids come last among ids; very
long texts are hashed whole; an empty table gives an empty result; other columns are ignored, or kept by ``deduplicate``
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, input_partitions, long_id, small_batches, stage, without

FAN_IN = 8
_SPACES = " \t\n\x0b\x0c\r"


def normal_form(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def digests(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """row_id, doc_id, n_points, digest, check: a row of 70 bytes for each document."""
    row_id = F.monotonically_increasing_id() if row_id is None else row_id
    return docs.select(row_id.alias("row_id"), long_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text")).select(
        "row_id", "doc_id", normal_form(F.col("text")).alias("plain"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    ).select("row_id", "doc_id", "n_points", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("check"))


_RUN = "place long, digest binary, check long, n_points long, keep_id long, keep_row long, members long"
_KEY = ("place", "digest", "check")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges sorted runs: of each key the first row stays (it is the best one) and members add up. One batch in memory."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table.cast(held.schema)]) if held is not None else table
        if not table.num_rows:
            continue
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            same = np.ones(table.num_rows - 1, bool)
            for name in _KEY:
                column = table[name].combine_chunks()
                same &= pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        first = np.flatnonzero(new)
        members = np.add.reduceat(table["members"].to_numpy(), first)
        merged = table.take(pa.array(first))
        merged = merged.set_column(merged.schema.get_field_index("members"), "members", pa.array(members, pa.int64()))
        held = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _exchange(runs: DataFrame, places: int) -> DataFrame:
    ordered = runs.repartitionById(places, F.col("place").cast("int")).sortWithinPartitions("place", "digest", "check", F.desc("n_points"), F.asc_nulls_last("keep_id"), "keep_row")
    return ordered.mapInArrow(_merge, _RUN)


def tree_merge(rows: DataFrame, leaves: int, fan_in: int = FAN_IN) -> DataFrame:
    """digest, check, keep_id, keep_row, members: one row for each distinct text."""
    rounds, places = 0, 1
    while places < leaves:
        rounds, places = rounds + 1, places * fan_in
    rounds, places = max(rounds, 1), max(places, fan_in)
    leaf = F.pmod(F.shiftrightunsigned("row_id", 33), F.lit(places))
    runs = rows.select(leaf.alias("leaf"), "digest", "check", "n_points", F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.lit(1).cast("long").alias("members"))
    target = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(places))
    runs = _exchange(runs.withColumnRenamed("leaf", "place"), places)  # round 0: each leaf sorts and merges its own run
    for r in range(1, rounds + 1):
        low = fan_in**r
        runs = _exchange(runs.withColumn("place", F.floor(F.col("place") / low) * low + F.pmod(target, F.lit(low))), places)
    return runs.select("digest", "check", "keep_id", "keep_row", "members")


def _decided(rows: DataFrame, leaves: int, fan_in: int) -> DataFrame:
    winners = tree_merge(rows, leaves, fan_in)
    leaf = F.shiftrightunsigned("row_id", 33)
    held = rows.select(leaf.alias("leaf"), "digest", "check").distinct()
    back = held.join(winners, ["digest", "check"])
    return rows.withColumn("leaf", leaf).join(back, ["leaf", "digest", "check"]).select(
        "row_id", "doc_id", "keep_id", F.col("members").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def decide(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    small_batches(docs.sparkSession)
    return _decided(stage(digests(docs), "digests"), input_partitions(docs), fan_in).drop("row_id")


def deduplicate(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. It is decided by row: of rows that repeat id and text, one stays.

    Where ids repeat or are null, the rows are written once with numbers of their own.
    """
    small_batches(docs.sparkSession)
    leaves, rows = input_partitions(docs), stage(digests(docs), "digests")
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        gone = _decided(rows, leaves, fan_in).where("not kept").select("doc_id")
        return without(docs, "doc_id", stage(gone, "exact-copies"))
    row = fresh(docs, "row_number")
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = stage(digests(held, held[row]), "digests")
    gone = _decided(rows, input_partitions(held), fan_in).where("not kept").select("row_id")
    return without(held, row, stage(gone, "exact-copies")).select(*[held[c] for c in docs.columns])
