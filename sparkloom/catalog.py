"""Every registered query of the reference's own operators, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import graph_queries, pipelines, rule_queries, sequence_queries, session_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (graph_queries, sequence_queries, session_queries, text_queries, rule_queries, pipelines)

QUERIES: dict[str, Query] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
