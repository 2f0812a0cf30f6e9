"""Registered training-data queries against their DuckDB SQL."""

from pathlib import Path

import duckdb
import pytest

from sylva.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
