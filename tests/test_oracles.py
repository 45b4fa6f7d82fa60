"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from threadlens.plans import feature_queries, history_queries, source_queries, text_queries
from threadlens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
assert feature_queries and history_queries and source_queries and text_queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    if name not in ORACLES:
        assert mine
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names)
    assert mine == sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["day", "total", "toxic", "toxic_reverted", "toxic_share"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
