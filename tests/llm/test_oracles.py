"""Queries with SQL give the rows of their SQL."""

import duckdb
import pytest

from datagauge.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    relation = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf_dir)
    assert got.columns == list(relation.columns)
    assert sorted(map(tuple, got.collect())) == sorted(relation.fetchall())
