"""Queries of text operators against their SQL on the smallest tables."""

import duckdb
import pytest

from lanewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((plain(r) for r in got.select(*columns).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)
