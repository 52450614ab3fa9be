import duckdb
import pytest

from glyphlake.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    ours = queries.queries()[name](spark, SMALL)
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(repr(tuple(r)) for r in ours.select(*columns).collect()) == sorted(map(repr, got.fetchall()))
