"""Every query against its SQL on the smallest tables: names, types and rows."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(values):
    return sorted(values, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    own = entry._queries.QUERIES
    assert set(own) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == described
    assert rows(map(tuple, got.select(*order).collect())) == rows(result.fetchall())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
