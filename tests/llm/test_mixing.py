"""Operator 4 against a plain recomputation, and its limits."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm.mixing import MixPlan, mix_sources, training_time


def filled(sizes, weights, total, cap):
    """Resharing in rounds until no source is above its limit."""
    level, full = {}, {}
    while True:
        left = {s: w for s, w in weights.items() if s not in full}
        rest = total - sum(full.values())
        level = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s, v in level.items() if v > cap * sizes[s]]
        if not over:
            return full | level
        full |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(spark, awkward_docs):
    rows = mix_sources(awkward_docs).collect()
    assert len(rows) == awkward_docs.count()
    size, docs = defaultdict(int), awkward_docs.collect()
    for r in docs:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = filled(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), 2)
    by_target = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is not None) == (r.taken > 0)
        by_target[r.source_size, round(r.target, 6)] += r.taken
    for s in order:
        taken = by_target[size[s], round(want[s], 6)]
        assert abs(taken - want[s]) < len(order) + 1 or size[s] == 0


def test_reruns_agree_and_order(spark, awkward_docs):
    one = mix_sources(awkward_docs).collect()
    again = mix_sources(awkward_docs.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, again))
    positions = [r.position for r in one if r.position is not None]
    assert positions == sorted(positions)


def test_empty(spark, awkward_docs):
    assert mix_sources(awkward_docs.limit(0)).count() == 0
    assert mix_sources(awkward_docs.where("doc_id = 3")).first().taken == 0


@pytest.mark.parametrize("knots", [((0, 1), (1, 3)), ((0, 0), (0.5, 2), (1, 0)), ((0, 2), (0.25, 2), (1, 1)), ((0, 0), (0.4, 0), (1, 1))])
def test_training_time_inverts_the_integral(spark, knots):
    plan = MixPlan(schedules=(knots,))

    def mass(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            e = min(max(t, a), b)
            total += (e - a) * (u + u + (v - u) * (e - a) / (b - a)) / 2
        return total

    rows = spark.range(50).select((F.col("id") / 50).alias("u")).withColumn("t", training_time(F.col("u"), F.lit(0), plan)).collect()
    for r in rows:
        assert mass(r.t) == pytest.approx(r.u * mass(1.0), abs=1e-9)


def test_every_reading_has_a_time(spark):
    """With three readings a document that is taken three times over begins three times, each later."""
    docs = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 10, "a"), (3, "w " * 400, "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mix_sources(docs, MixPlan(weights=(1000, 1), most_repeats=3)).collect()}
    for i in (1, 2):
        assert rows[i].taken == 30 and [r.words for r in rows[i].readings] == [10, 10, 10]
        times = [r.time for r in rows[i].readings]
        assert times == sorted(set(times)) and times[:2] == [rows[i].position, rows[i].repeat_position]
    assert all(r.taken == sum(x.words for x in r.readings) for r in rows.values())
