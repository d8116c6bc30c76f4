"""Every registered raster query against DuckDB on the same tables, rows and types."""

import os

import duckdb
import pytest

from rastrel import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SQL = registry.oracle_sql()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def rows(table, columns):
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns])))


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_equals_sql(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir).toArrow()
    want = con.sql(SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert [str(got.schema.field(c).type) for c in columns] == [str(want.schema.field(c).type) for c in columns]
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_query_without_sql_repeats_itself(spark, sf_dir, name):
    one, two = (registry.queries()[name](spark, sf_dir).toArrow() for _ in range(2))
    assert one.num_rows and rows(one, one.column_names) == rows(two, two.column_names)
