"""Every query of the library against its SQL on DuckDB, over the driver's tables."""

import os

import duckdb
import pytest

from loomlog.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tiny}/{name}')")
    return con


def values(columns, rows):
    """Rows as text with columns in the order of their names; sets of rows are compared, so order does not count."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order]) for r in rows)


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, tiny, name):
    df = catalog.queries()[name](spark, tiny)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert values(df.columns, df.collect()) == values(columns, want.fetchall())
