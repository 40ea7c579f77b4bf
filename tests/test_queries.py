"""Every registered query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(names, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert sorted(df.columns) == ["n", "percent", "split"]
    assert df.count() == 2


def test_golden_split(spark):
    """60 of 2,000 patches drawn: 1,537 remain, their numbers add up to 1,512,214."""
    from patchloom.operators.dataset import independent_split
    from patchloom.plans.fixtures import view

    patches = view(spark, "/root/testdata/sf0.01", "patches")
    _, rest = independent_split(patches, 60)
    row = rest.selectExpr("count(*) n", "sum(pid) s").first()
    assert (row["n"], row["s"]) == (1537, 1512214)
