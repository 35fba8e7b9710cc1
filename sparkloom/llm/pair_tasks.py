"""Deals the rows of candidate groups out to tasks that compare pairs, splitting hot groups.

A group of up to ``SMALL`` rows is one task. A larger one is cut into c chunks and gets a task for each pair of chunks,
so that all its pairs are still met. c grows with the root of the group's size: a task's rows grow with the root too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage

SMALL = 1024
#: Rows about hot groups that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def deal(rows: DataFrame, group: list[str], spread_by: str, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with task_i, task_j and chunk, dealt out and sorted by task. Pairs of one chunk are met in task (i, i).

    ``keys``: a cheaper way to the group columns of ``rows``, if there is one; it is what hot groups are counted on.
    """
    hot = (rows if keys is None else keys).groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL)
    hot = stage(hot.select(*group, F.ceil(F.sqrt("_n") / 16).cast("int").alias("_chunks")), "hot-groups")
    n_hot = hot.count()
    many = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, group, "left") if n_hot else rows.withColumn("_chunks", F.lit(1))
    many = many.withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    many = many.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), F.col(spread_by)), F.col("_chunks")).cast("int"))
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    many = many.withColumn("task_i", F.least("chunk", "_other")).withColumn("task_j", F.greatest("chunk", "_other")).drop("_other", "_chunks")
    return many.repartition(*group, "task_i", "task_j").sortWithinPartitions(*group, "task_i", "task_j")


def whole_tasks(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 8192, at_least_bytes: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroups a sorted stream into tables that hold whole tasks only, with the row at which each task starts.

    A table has so many rows, or bytes, or a single task that has more.
    """
    held: list[pa.Table] = []
    rows = size = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            new[1:] = False
            for k in keys:
                c = table[k].to_numpy()
                new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        size += batch.nbytes
        if rows < at_least and size < at_least_bytes:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cut = starts(table)
        if len(cut) > 1:
            yield table.slice(0, cut[-1]), cut[:-1]
            table = table.slice(cut[-1])
        held, rows, size = [table], 0, 0
    if held:
        table = pa.concat_tables(held).combine_chunks()
        if table.num_rows:
            yield table, starts(table)
