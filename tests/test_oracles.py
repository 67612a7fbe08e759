"""Every registered query of the reference's operators against its independent SQL."""

import decimal
import math
import os

import duckdb
import pytest

from inkwell.plans import registry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{ROOT}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr([plain(r[n]) for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, ROOT).toArrow()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_columns and len(set(got.column_names)) == got.num_columns


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
