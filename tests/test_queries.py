"""Every query that has SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from palimpsest import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "events", "benchmark", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(name, spark, duck):
    mine = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in theirs.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_run(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["chain_start", "delta_parent", "chain_walk"])
def test_walks_by_a_task_match_sql(name, spark, duck, monkeypatch):
    from palimpsest.operators import layers

    monkeypatch.setattr(layers, "DRIVER_ROWS", 0)
    spark.sparkContext.setJobGroup(f"query-{name}", "")
    try:
        mine = catalog.QUERIES[name](spark, SF)
        got = sorted(tuple(r) for r in mine.collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert mine.columns == theirs.columns and got == sorted(theirs.fetchall())
    # not one for each step: the walks take 24 steps and more
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"query-{name}")) < 50
