"""Every registered point-cloud query against its SQL in DuckDB, on the same tables."""

import os

import duckdb
import pytest

from tessera.plans import registered as catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return [names[i] for i in order], sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(catalogue.SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want
    assert want[1]
