"""All registered queries run on the smallest size, and those with SQL give its rows."""

import math

import duckdb
import pytest

import __spark_entry__
from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0 if math.isfinite(x) else str(x)
    return tuple(map(tidy, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(tidy, r))) for r in df.select(*columns).collect())
    assert got or name in {"url_rank", "index_stale"}
    if sql := registry.ORACLES.get(name):
        rel = db.sql(sql)
        assert columns == sorted(rel.columns)
        order = [rel.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(tidy(r[i]) for i in order)) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "chunk_id", "title", "relevance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
