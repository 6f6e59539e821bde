"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from graphloom.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    t = table.select(sorted(table.column_names)).to_pydict()
    return sorted(map(repr, zip(*t.values(), strict=True)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in SQL:
        want = duck.execute(SQL[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0
