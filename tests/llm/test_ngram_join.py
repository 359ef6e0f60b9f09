"""Operator 8 against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm.ngram_join import JoinPlan, _sketch_table, candidates, jaccard_classes, overlaps, shared_bands, signature, signature_bytes, windows
from linkloom.session import table


def sets_of(rows, n=5):
    out = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def by_hand(rows):
    """(doc_id, class id, links) by comparing all pairs."""
    sets = sets_of(rows)
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * len(b) <= 5 * len(a) and 4 * len(a) <= 5 * len(b):
                common = len(a & b)
                if 9 * common >= 4 * (len(a) + len(b)):
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i in range(n):
        if rows[i].doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), rows[i].doc_id), rows[i].doc_id)
    return sorted(((r.doc_id, ids.get(find(i)), links[i]) for i, r in enumerate(rows)), key=str)


def run(docs, plan=JoinPlan()):
    got = jaccard_classes(docs, plan).collect()
    classes = {}
    for r in got:
        classes[r.class_id, r.first] = classes.get((r.class_id, r.first), 0) + 1
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str), got


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got, rows = run(docs)
    assert got == by_hand(docs.collect())
    assert sum(r.first for r in rows) == len({r.class_id for r in rows})
    assert all(r.doc_id == r.class_id for r in rows if r.first)


@pytest.mark.parametrize("plan", [JoinPlan(), JoinPlan(block=16, block_words=900)])
def test_large_groups(spark, plan):
    """A group of near copies and one of copies, in one block and in many."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(100)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "the very same text of eight words here") for i in range(40)]
    rows += [(2000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:50])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, plan)[0] == by_hand(docs.collect())


def test_empty_blocks(spark):
    """Clusters of two or three long texts in more blocks than texts: links in one block count once."""
    rng = random.Random(6)
    rows = []
    for c in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(10 * c + i, " ".join([*base[: 195 + i], f"t{i}"])) for i in range(2 + c % 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (100, 250):
        assert run(docs, JoinPlan(block_words=words))[0] == by_hand(docs.collect())


def test_awkward(spark, awkward_docs):
    short = spark.createDataFrame([(500, "a b"), (501, "a  b"), (502, "a"), (503, "A b"), (504, None)], "doc_id long, text string")
    docs = awkward_docs.unionByName(short, allowMissingColumns=True)
    got, rows = run(docs)
    assert got == by_hand(docs.collect())
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200), dtype=np.uint64)) for _ in range(70)]
    sets += [np.unique(rng.integers(0, 10**6, 50, dtype=np.uint64)) for _ in range(5)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (overlaps(sets) == np.array(want)).all()


def test_bands_meet_the_recall():
    bands, rows = JoinPlan().shape
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_words_of_one_checksum(spark):
    """Words that a 32-bit checksum confuses make different n-grams."""
    docs = spark.createDataFrame([(1, "the old red barn plumless"), (2, "the old red barn buckeroo"), (3, "the old red barn plumless")], "doc_id long, text string")
    assert run(docs)[0] == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]


@pytest.mark.parametrize("vocabulary", [3, 300, 70_000])
def test_windows_are_exact(vocabulary):
    rng = np.random.default_rng(vocabulary)
    ids = rng.integers(0, vocabulary + 1, 5000)
    ids[2500:3500] = ids[:1000]
    starts = np.arange(len(ids) - 4)
    codes = windows(ids, starts, 5, vocabulary)
    rows = [tuple(ids[i : i + 5].tolist()) for i in starts]
    assert len(set(zip(codes.tolist(), rows))) == len(set(rows)) == len(set(codes.tolist()))


def test_chain(spark):
    """A chain in which only neighbours are alike is verified by neighbours, however long it is."""
    rng = random.Random(8)
    tape = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    docs = spark.createDataFrame([(i, " ".join(tape[i * 8 : i * 8 + 80])) for i in range(600)], "doc_id long, text string")
    plan = JoinPlan()
    sketched = _sketch_table(docs, plan)
    payload = sketched.select(F.col("row").alias("rep"), "signature", "bands")
    met = candidates(shared_bands(sketched, plan), payload, plan)
    per_group, rows = Counter(r.g for r in met.collect()), met.count()
    assert rows <= 600 * 4 and max(per_group.values()) <= 8
    assert run(docs)[0] == by_hand(docs.collect())


def test_signatures_of_long_texts_differ():
    """Entries of unlike texts agree by chance alone, however many n-grams there are."""
    rng = np.random.default_rng(3)
    for size in (10, 1000, 50_000):
        a, b = (np.frombuffer(signature_bytes(signature(rng.integers(0, 2**63, size, dtype=np.uint64), 5, 120)), np.uint8) for _ in range(2))
        assert (a == b).sum() <= 6
