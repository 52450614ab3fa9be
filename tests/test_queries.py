import duckdb
import pytest

import __spark_entry__ as entry
from glyphlake.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SMALL)
    got = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(ours.columns)
    want = sorted(map(repr, got.fetchall()))
    assert sorted(repr(tuple(r)) for r in ours.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
