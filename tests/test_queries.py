"""Every catalogued query against its SQL, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sievewright.plans import catalog, files  # noqa: F401  files adds its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
        return repr(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    shown = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {shown} from ({catalog.SQL[name]}) q").fetchall()
    assert plain(got) == plain(want) and got


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
