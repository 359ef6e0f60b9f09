"""Components against union-find on random graphs, a path, stars and cycles."""

import random

import pytest

from linkloom.llm.components import components


def by_hand(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


rng = random.Random(7)
GRAPHS = {
    "path": [(i, i + 1) for i in range(70)],
    "shuffled path": list(zip(p := rng.sample(range(80), 80), p[1:])),
    "stars": [(100 * c, 100 * c + i) for c in range(4) for i in range(1, 40)] + [(130, 250)],
    "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
    "cycle": [(i, (i + 1) % 30) for i in range(30)] + [(5, 5), (0, 1)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: v for k, v in by_hand(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
