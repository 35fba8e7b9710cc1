"""Sinks: the graph, its manifest, metrics, reports and next moves. Whatever holds text from outside passes the privacy gate.

A guarded sink works its rows out once: each task audits what it writes, into a folder beside the target, and only a query
of which all tasks passed is published by a rename. A leak in any row leaves the target as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, bridges: DataFrame, meta: DataFrame) -> None:
    """Four Parquet tables under ``path``."""
    for name, df in (("neurons", nodes), ("synapses", edges), ("insights", bridges), ("meta", meta)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """``manifest(name, label, count, synapses)`` with ``entries`` in place of those of the same name, by name."""
    return manifest.join(entries.select("name"), "name", "left_anti").unionByName(entries).orderBy("name")


def publish(path: str, rows: DataFrame, rule: Callable[[Column], Column] = T.leaks_anything, exempt: tuple[str, ...] = ()) -> None:
    """JSON lines in the folder ``path``, in place of what was there, if every row passes ``rule``; else nothing changes."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = hadoop(path.rstrip("/")), hadoop(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        audit.guarded(rows, rule, exempt).write.json(beside.toString())
        store.delete(target, True)
        if not store.rename(beside, target):
            raise OSError(f"{beside} could not be renamed to {target}")
    except Exception as error:
        field = audit.is_refusal(error)
        if field:
            raise audit.PrivacyError(f"a value of {field!r} looks like a path, an address or a secret") from None
        raise
    finally:
        store.delete(beside, True)


def write_metrics(path: str, metrics: DataFrame) -> None:
    """One JSON object; nothing is written if anything in it looks unsafe."""
    publish(path, metrics.coalesce(1))


def write_report(path: str, report: DataFrame) -> None:
    """JSON lines, one for each profile; prose is held to the narrower rule."""
    publish(path, report, T.leaks, exempt=("profile",))


def write_next_moves(path: str, moves: DataFrame) -> None:
    """One JSON object of nudges, footer and meta; the numbers in meta are not prose."""
    publish(path, moves.coalesce(1), T.leaks, exempt=("meta",))


def write_sheet(path: str, sheet: DataFrame) -> None:
    """A blind sheet: ids alone, a row for each source."""
    publish(path, sheet)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
