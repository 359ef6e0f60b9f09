"""Every registered query of the engine against its SQL in DuckDB, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from linkloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_llm():
    """Only the entry module guards the import, and nothing else in the library imports the subpackage."""
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(f"{root}/linkloom"):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                assert "linkloom.llm" not in open(f"{folder}/{n}").read()
