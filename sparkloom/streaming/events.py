"""Event logs as streams: hourly counts within a watermark, and per-session tool moves with state.

The batch operators stay the reference for both; tests compare them over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, name, n) of ``events(ts, name)``; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "name").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "name", "n")


def moves(events: DataFrame) -> DataFrame:
    """(session, before, next) of ``events(session, seq, name)`` that arrive in order: the last tool is the state."""
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            names = frame.sort_values("seq")["name"].tolist()
            before = [last, *names[:-1]] if names else []
            last = names[-1] if names else last
            out = pd.DataFrame({"session": key[0], "before": before, "next": names})
            yield out[out["before"].notna()]
        if last is not None:
            state.update((last,))

    return events.groupBy("session").applyInPandasWithState(step, "session long, before string, next string", "last string", "append", GroupStateTimeout.NoTimeout)
