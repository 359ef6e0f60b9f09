"""Registered queries against their SQL in DuckDB, on the given tables and on made ones."""

import math
import os

import duckdb
import pytest
from test_secrets import KEY, PART

from linkloom.llm.queries import OP9_SQL, ORACLE_SQL, QUERIES
from linkloom.llm.secrets import scan


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def rows_of(result, columns):
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    df = QUERIES[name](spark, sf)
    assert sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=str) == rows_of(con.execute(ORACLE_SQL[name]), df.columns)


def test_secrets_linked_as_in_sql(spark):
    """Every kind of part at every edge of a scope, on either side, and in crowds."""
    token, url, assigned, digits = PART, "https://store.example/b?c=d", "token=abcdefghijkl", "0123456789abcdef01"
    texts = [None, "", KEY, f"{KEY}{KEY}", f"{token}={KEY}", f"ſecret={'x' * 20} KEY {KEY} toKen: {'y' * 20}", f"redis://h/{KEY} {token}", f"{token}== {KEY}", f"{token}=== {KEY}", f"é{token}é {KEY} HTTPS://x\x0by"]
    for gap in (0, 1, 255, 256, 257, 300, 1023, 1024, 1025):
        for a in (token, url, token * 12, url + "/q" * 900):
            texts += [f"{a}{' ' * gap}{assigned}", f"{assigned}{'.' * gap} {a}", f"{a}{' ' * gap}{digits}", f"{a}{' ' * gap}{KEY}", f"{KEY}{' ' * gap}{a}", f"\U0001f600{KEY} {a}{' ' * gap}{assigned}", f"{digits}{' ' * gap}{a} {KEY}", f"{a}{'.' * gap} {KEY} {token} {a}"]
    texts += [" ".join([KEY, token, url, assigned, digits] * 60), (f"{token} " * 40 + KEY) * 5]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("found")
    want = rows_of(con.execute(OP9_SQL), got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum("part" in str(r) for r in want) > 50 and sum("endpoint" in str(r) for r in want) > 20
