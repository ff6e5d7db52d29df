"""Every query with SQL equals DuckDB on the same tables."""

import os

import duckdb
import pytest

from rasterweave.plans import registry


def tables(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    con, sql = tables(sf_dir), registry.ORACLES[name]
    columns = sorted(con.sql(sql).columns)
    assert sorted(df.columns) == columns
    want = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_schema(spark, sf_dir):
    df = registry.flagship(spark, sf_dir)
    assert df.columns == ["frame_id", "y", "x", "r", "g", "b"]
    assert df.count() == 64 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_stencil_chain_has_one_exchange(spark, sf_dir):
    from rasterweave.plans.raster_queries import hysteresis_onehop

    plan = hysteresis_onehop(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
