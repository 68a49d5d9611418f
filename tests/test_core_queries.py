"""Every registered query with SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from graphloom.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    want = duck.sql(oracles.ORACLES[name])
    columns = sorted(want.columns)
    out = queries.QUERIES[name](spark, SF)
    assert sorted(out.columns) == columns
    assert dict(out.dtypes) == {c: KINDS[str(t)] for c, t in zip(want.columns, want.types, strict=True)}
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    """Their operators are held against brute force or hand-made cases in the other files."""
    assert queries.QUERIES[name](spark, SF).count() > 0
