"""Operator 9: base spans against Python's matches; linking by hand; redaction."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from linkloom.llm.secrets import redacted, scan
from linkloom.session import table

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KEY = "AKIA" + "Q3EXAMPLEZ7" * 2
PART = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def text_of(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def check(docs):
    got = scan(docs).collect()
    want = [(r.doc_id, *(sum(f[1] == k for f in base(r.text)) for k in range(3)), hashlib.sha256(text_of(base(r.text)).encode()).hexdigest()) for r in docs.collect()]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    return {r.doc_id: r.spans for r in got}


def test_base_spans(spark, awkward_docs, sf):
    rng = random.Random(2)
    bits = ["password", "API_KEY", "apikey", "Token", "=", ":", " ", '"', "'", "abcdefabcdef0123456789", "AKIA", "ABCDEFGHIJ1234567", "é\U0001f600", "short", "x" * 12, "\n"]
    rows = [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(5000, "password=" + "a1" * 8 + " " + ("0123456789abcdef " * 3000)), (5001, 'password: "secret":"abcdefghijklmnop"'), (5002, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    spans = check(awkward_docs.unionByName(made, allowMissingColumns=True).unionByName(table(spark, sf, "documents"), allowMissingColumns=True))
    for i, t in rows[:400]:
        assert set(filter(None, text_of(base(t)).split(","))) <= set(spans[i].split(","))
    assert scan(awkward_docs.limit(0)).count() == 0


def test_linking(spark):
    far = " filler" * 200
    rows = [
        (1, f"id {KEY} key {PART} at https://store.example/bucket"),
        (2, f"key {PART} at https://store.example/bucket"),
        (3, f"id {KEY}{far} key {PART}"),
        (4, f"id {KEY} at https://store.example/bucket"),
        (5, "x" * 1020 + f" {PART} {KEY}"),
        (6, f"{KEY} https://store.example/a token={'z9' * 8}"),
    ]
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",")] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kinds == {1: ["access", "part", "endpoint"], 2: [""], 3: ["access"], 4: ["access"], 5: ["part", "access"], 6: ["access", "endpoint", "assign"]}


def test_parts_that_complete_each_other(spark):
    """An assigned secret and an address are a credential without an identifier too; a digest or a token and an address are not."""
    url, far = "postgres://user@db.example:5432/app", " filler" * 60
    rows = [(1, f"password: abcdefghijkl {url}"), (2, f"{url}{far} password: abcdefghijkl"), (3, f"commit 0123456789abcdef0123 {url}"), (4, f"{PART} {url}"), (5, f"{url} {'0123456789abcdef0123'} {KEY}")]
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",")] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kinds == {1: ["assign", "endpoint"], 2: ["assign"], 3: ["hex"], 4: [""], 5: ["endpoint", "hex", "access"]}


def test_long_candidates_link_on_either_side(spark):
    """What counts is the gap between two spans, however long they are."""
    token, url = "aB3dE" * 80, "https://store.example/" + "q/" * 600
    rows = [
        (1, f"{token} {KEY}"), (2, f"{KEY} {token}"), (3, f"{token}{' ' * 256}{KEY}"), (4, f"{token}{' ' * 257}{KEY}"), (5, f"{KEY}{' ' * 257}{token}"),
        (6, f"{url} {KEY} {token}"), (7, f"{KEY} {url} token={'z9' * 8}"), (8, "aB3dE" * 900 + f" {KEY}"),
    ]
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",")] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kinds == {
        1: ["part", "access"], 2: ["access", "part"], 3: ["part", "access"], 4: ["access"], 5: ["access"],
        6: ["endpoint", "access", "part"], 7: ["access", "endpoint", "assign"], 8: ["part", "access"],
    }


def test_redaction(spark):
    text = f"é {KEY} then password=abcdefabcdefabcdef0 end"
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    out = {r.doc_id: r.t for r in scan(docs, carried=["text"]).select("doc_id", redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert out == {1: "é [secret] then [secret] end", 2: "nothing"}
