"""Operator 10: folds, label model and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm.toxicity import Lexicon, ToxicPlan, _terms, fit_label_model, fit_linear, fold, score_documents, votes
from linkloom.session import table


def test_fold_is_crc32(spark):
    for r in spark.range(300).select("id", fold(F.col("id")).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.id).encode()) % 5


def test_voters_see_whole_texts():
    lexicon = Lexicon(frozenset([_terms["vile"][0]]), frozenset())
    quiet, loud = "vile " + "ab " * 8000, "vile " + "ab " * 8000 + "AB " * 8000
    assert [a for a, b in zip(votes(loud, lexicon), votes(quiet, lexicon)) if a != b] == [1]


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    accuracy = [0.9, 0.8, 0.7, 0.85, 0.6]
    votes = np.stack([np.where(rng.random(6000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accuracy], 1)
    votes = np.concatenate([votes, votes[:, [4]], votes[:, [4]]], 1).astype(np.int8)  # a weak voter, three times
    model = fit_label_model(votes, 0.3, 100)
    for j in (0, 1, 3):
        assert model.tables[j, 1, 2] == pytest.approx(accuracy[j], abs=0.06)
    assert model.correlations[4, 5] > 0.9 and model.weights[4] < 0.5 < model.weights[0]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def test_linear_matches_newton():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    target = 1 / (1 + np.exp(-(x @ [2, -1, 0.5, 0, 1, -2] - 0.3)))
    x = np.hstack([x, np.ones((400, 1))])  # every row has a feature
    rows, columns = np.nonzero(x)
    w, b = fit_linear(np.searchsorted(rows, np.arange(400)), columns, np.ones(len(rows)), 7, target, 1e-3)
    full, z = np.hstack([x, np.ones((400, 1))]), np.zeros(8)
    ridge = np.diag([1e-3] * 7 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ z))
        z -= np.linalg.solve(full.T * (p * (1 - p)) @ full / 400 + ridge, full.T @ (p - target) / 400 + ridge @ z)
    assert np.allclose(np.append(w, b), z, atol=2e-3)


def plainly(rows, labels, plan):
    """The whole operator on a few documents, with dictionaries and loops: scores by text."""
    known = {}
    for i, y in labels:
        if y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    train = [(t, known[i]) for i, t in rows if i in known]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    hashed = lambda k: zlib.crc32(k.encode()) % (1 << 20)
    terms = lambda w: [hashed(w), *(hashed(f"{w[:n]}*") for n in (3, 4, 5, 6, 7) if len(w) >= n)]

    def counts(t):
        out = Counter()
        for w in words(t):
            out.update(terms(w))
        return out

    held = {y: Counter() for y in (0, 1)}
    for t, y in train:
        held[y].update(set(counts(t)))
    n = Counter(y for _, y in train)
    rate = {y: {k: (held[y][k] + 0.5) / (n[y] + 1) for k in set(held[0]) | set(held[1])} for y in (0, 1)}
    every = sorted(rate[0])
    lexicon = {k for k in every if held[1][k] >= plan.least_support and rate[1][k] / (rate[1][k] + rate[0][k]) >= 0.9 and held[1][k] / (held[1][k] + held[0][k]) >= plan.lexicon_share}
    worth = {k: abs(math.log(rate[1][k]) - math.log(rate[0][k])) * math.sqrt(min(held[1][k] / n[1] + held[0][k] / n[0], 0.2)) for k in every if held[0][k] + held[1][k] >= plan.least_support}
    index = sorted([k for k in sorted(worth, key=lambda k: (-worth[k], k))[: plan.features] if worth[k] > 0]) + [1 << 20]
    value = lambda t: [math.log2(1 + (len(words(t)) if k == 1 << 20 else counts(t)[k])) for k in index]
    cast = np.array([votes(t, Lexicon(frozenset(lexicon), frozenset(lexicon))) for t, _ in train])
    model = fit_label_model(cast, n[1] / (n[0] + n[1]), plan.rounds)
    target, x = model.posterior(cast), np.array([value(t) + [1.0] for t, _ in train])
    w, ridge = np.zeros(x.shape[1]), np.diag([plan.ridge] * len(index) + [0.0])
    for _ in range(100):  # Newton's method on the same convex loss
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x / len(x) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - target) / len(x) + ridge @ w)
    return {t: 1 / (1 + math.exp(-(np.array([*value(t), 1.0]) @ w))) for _, t in rows}


def test_scores_by_hand(spark):
    """Scores of a small table against the plainly written operator."""
    rng = random.Random(4)
    kind, vile = ["fine", "good", "plain", "word", "table", "river"], ["vilest", "vileness", "cursed", "cursing"]
    rows = [(i, " ".join(rng.choice(kind) for _ in range(rng.randrange(5, 40))) + (" " + " ".join(rng.choice(vile) for _ in range(rng.randrange(1, 4))) if i % 3 == 0 else "")) for i in range(240)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows if i % 7] + [(3, 1), (4, 0), (5, None)]
    plan = ToxicPlan(ridge=1e-2)
    want = plainly(rows, labels, plan)
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), plan).collect()
    text = dict(rows)
    assert max(abs(r.score - want[text[r.doc_id]]) for r in got) < 5e-3
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in got)


def test_gathered_bytes_are_bounded(spark):
    """Past the bound rows are left out of the fit, and scores still come for all."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "good", "plain"]) for _ in range(30)) + (" vile" if i % 2 else "")) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    for most in (1, 3000, 1 << 30):
        got = score_documents(docs, labels, ToxicPlan(most_bytes=most)).collect()
        assert len(got) == 200 and all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    scored = score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert scored.count() == docs.count()
    hit = rows[rows.toxic == 1]
    assert (hit.predicted == 1).mean() > 0.85
    assert (rows[rows.toxic == 0].predicted == 0).mean() > 0.98
    rank = rows.score.rank()
    n1, n0 = len(hit), len(rows) - len(hit)
    assert (rank[rows.toxic == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0 > 0.95


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["fine", "good", "plain", "word"]) for _ in range(30)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    honest = [(i, int(i % 3 == 0)) for i, _ in rows]
    flipped = [(i, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in honest]
    a, b = (score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).toPandas() for x in (honest, flipped))
    assert (a.sort_values("doc_id").score.to_numpy() == b.sort_values("doc_id").score.to_numpy()).all()
    assert ((a.sort_values("doc_id").predicted == 1) == [i % 3 == 0 for i, _ in rows]).mean() > 0.97


def test_awkward(spark, awkward_docs):
    labels = spark.createDataFrame([(101, 1), (102, 0), (None, 1), (103, None), (103, 0), (103, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        rows = score_documents(awkward_docs, some).collect()
        assert len(rows) == awkward_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert score_documents(awkward_docs.limit(0), labels).count() == 0
