"""Queries that have SQL against it, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from setaccio.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, rows, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = queries.QUERIES[name](spark, sf)
    assert rows(got) == sorted(con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({queries.SQL[name]})").fetchall(), key=repr)
    assert set(queries.SQL) <= set(queries.QUERIES)
