"""Every registered query of the core against its SQL, over the smallest tables; those without SQL must return rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from sparkloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow, and covered by tests of their parts.
SKIP = {"brain_of_documents"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 or name in {"session_shape"}
    if name in catalog.ORACLES:
        want = sql.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
