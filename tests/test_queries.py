"""Every registered query with SQL gives the SQL's rows, on the smallest tables where they exist."""

import os

import pytest

from skyfront.plans import catalogue

DATA = os.environ.get("SKYFRONT_TEST_DATA", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLE_SQL])
def test_rows_match(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    have = [c[0] for c in cursor.description]
    assert sorted(have) == names
    wanted = [tuple(plain(r[have.index(n)]) for n in names) for r in cursor.fetchall()]
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL and n not in ("o6_sweep", "g5_initial_design")])
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_sweep_has_every_strategy_and_three_seeds(spark):
    from skyfront.operators import campaign

    rows = {r.strategy: r for r in catalogue.QUERIES["o6_sweep"](spark, DATA).collect()}
    assert rows.keys() == campaign.default_strategies().keys()
    assert all(len(r.auc_hv_by_seed) == 3 and abs(sum(r.auc_hv_by_seed) / 3 - r.auc_hv_mean) < 1e-9 for r in rows.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["grp", "hv"]


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    from skyfront.plans import bindings

    df = bindings.table(spark, DATA, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_shipdate" not in plan
