"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lanewright import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query(spark, sf_dir, db, name):
    want = db.execute(oracle.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE_SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_zones_grow_past_the_steps_that_the_sql_follows(spark, tmp_path):
    """A street winding through a block: 60 steps do not reach its end. With more
    of them, and nothing else changed, the SQL agrees."""
    cells = [(p, p // 20, p % 20) for p in range(400)]
    part = [(p, "STANDARD", "Brand#11", 1 if r % 2 == 0 or c == (19 if r % 4 == 1 else 0) else 3, 900.0) for p, r, c in cells]
    spark.createDataFrame(part, "p_partkey long, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = queries.bfs_partition(spark, str(tmp_path))
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    sql = oracle.ORACLE_SQL["bfs_partition"]
    assert sql.count("p.h<60") == 1
    short, whole = (rows([d[0] for d in want.description], want.fetchall()) for text in (sql, sql.replace("p.h<60", "p.h<400")) for want in [con.execute(text)])
    assert mine == whole and mine != short
