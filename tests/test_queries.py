"""Every query with SQL against DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spandrel.plans.catalogue import QUERIES
from spandrel.plans.oracles import ORACLES
from spandrel.sources.tables import TABLES


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    flat = [tuple(repr(round(float(r[i]), 6) + 0.0) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in data]
    return sorted(names), sorted(flat)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(ORACLES[name])
    assert got == rows([d[0] for d in done.description], done.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(ORACLES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_no_cartesian_product(spark, sf_dir):
    for name in ("route_chart", "label_chain_associate", "grid_nearest"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
