"""Operator 5: exact round trip of every document, full sequences, shares within windows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm.mixing import source_key
from linkloom.llm.packing import PackPlan, pack, served_order

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))



def test_every_id_lies_in_one_piece(spark, awkward_docs):
    library = Tokenizer.from_file(PATH)
    docs = awkward_docs.collect()
    ids = [library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs]
    pieces = pack(awkward_docs, PATH).collect()
    want = defaultdict(int)
    for r, own in zip(docs, ids):
        want[r.doc_id] += len(own)
    got = defaultdict(int)
    fits = {(r.doc_id, len(own)): np.array(own, "<u4") for r, own in zip(docs, ids)}
    for p in pieces:
        got[p.doc_id] += p.length
        own = fits[p.doc_id, p.doc_tokens]
        assert zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert got == want
    filled = defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for k, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == max(filled)


def test_windows_keep_the_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ("a", "b", "c")[int(rng.choice(3, p=[0.6, 0.3, 0.1]))], int(rng.integers(1, 5000))) for i in range(900)]
    queued = spark.createDataFrame(rows, "__row long, source string, n long").select(
        "__row", source_key(F.col("source")).alias("source_key"), "n", (F.col("__row") % 16).cast("int").alias("__bucket"), F.hash("__row").alias("__key")
    )
    plan = PackPlan(sequence=2048, window=32768)
    sent = served_order(queued, plan).toPandas().sort_values("place")
    assert sent.length.sum() == sum(r[2] for r in rows)
    assert (sent.place.diff().dropna().to_numpy() == sent.length.to_numpy()[:-1]).all()
    share = sent.groupby("source_key").length.sum() / sent.length.sum()
    served = sent.groupby(["window", "source_key"]).length.sum().unstack(fill_value=0).cumsum()
    for s in share.index:  # a queue is never ahead of its quantum, nor behind by a packet or more
        owed = np.minimum(share[s] * plan.window * (served.index.to_numpy() + 1), served[s].max())
        assert (served[s] <= owed + 1e-6).all() and (owed - served[s] < 2048 + 1e-6).all()


def test_given_shares(spark):
    rows = [(i, "ab"[i % 2], 100) for i in range(400)]
    queued = spark.createDataFrame(rows, "__row long, source string, n long").select(
        "__row", source_key(F.col("source")).alias("source_key"), "n", F.lit(0).alias("__bucket"), F.col("__row").alias("__key")
    )
    sent = served_order(queued, PackPlan(window=4000), {"a": 3.0, "b": 1.0}).toPandas()
    first = sent[sent.window < 6].groupby("source_key").length.sum()
    assert first["0a"] == pytest.approx(3 * first["0b"], rel=0.05)
    assert sent.length.sum() == 40000


def plainly_served(queues, weights, window):
    """Deficit round-robin, packet by packet: each round adds to every waiting queue its share of the window."""
    sent, deficit, at = [], dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0)
    total, done, r = sum(map(sum, queues.values())), 0, 0
    level = 0.0
    while done < total:
        # The level by which the queues, those run dry aside, have together sent r + 1 windows.
        r += 1
        goal = min(r * window, total)
        low, high = level, level + total / min(weights.values()) + 1
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(sum(q), weights[s] * mid) for s, q in queues.items()) < goal else (low, mid)
        for s in sorted(queues):
            deficit[s] += weights[s] * (high - level)
            while at[s] < len(queues[s]) and queues[s][at[s]] <= deficit[s] + 1e-6:
                deficit[s] -= queues[s][at[s]]
                sent.append((r - 1, s, queues[s][at[s]]))
                done += queues[s][at[s]]
                at[s] += 1
        level = high
        if r > 10 * total / window + 10:
            break
    return sent


def test_weights_match_plain_rounds(spark):
    """Target weights against deficit round-robin played out packet by packet, to the tail."""
    rng = np.random.default_rng(9)
    rows = [(i, ("a", "b", None)[int(rng.choice(3, p=[0.2, 0.5, 0.3]))], int(rng.integers(1, 1500))) for i in range(500)]
    queued = spark.createDataFrame(rows, "__row long, source string, n long").select("__row", source_key(F.col("source")).alias("source_key"), "n", F.lit(0).alias("__bucket"), F.col("__row").alias("__key"))
    plan = PackPlan(weights=(5, 2, 1), window=16384)
    sent = served_order(queued, plan).toPandas().sort_values("place")
    queues = {k: [n for _, s, n in rows if s == source] for k, source in (("0a", "a"), ("0b", "b"), ("1", None))}
    assert list(zip(sent.window, sent.source_key, sent.length)) == plainly_served(queues, {"0a": 5.0, "0b": 2.0, "1": 1.0}, 16384)
    first = sent[sent.window < 3].groupby("source_key").length.sum()
    assert first["0a"] / first.sum() == pytest.approx(5 / 8, abs=0.05)


def test_query_fills_windows_to_weights(spark, sf):
    """The registered query: while all sources last, sequences hold them by weight; nothing is lost."""
    from linkloom.llm.queries import op5_pack

    pieces = op5_pack(spark, sf).toPandas()
    size = pieces.groupby("source_key").length.sum()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size.index))}
    level = min(size[s] / weights[s] for s in weights)  # where the first queue runs dry
    full = int(level * sum(weights.values()) // (64 * 2048)) * 64
    if full:
        part = pieces[pieces.sequence_id < full].groupby("source_key").length.sum()
        for s, w in weights.items():
            assert part[s] / part.sum() == pytest.approx(w / sum(weights.values()), abs=0.05)
    assert (pieces.groupby("sequence_id").length.sum() == 2048).sum() >= pieces.sequence_id.max()


def test_empty(spark, awkward_docs):
    assert pack(awkward_docs.limit(0), PATH).count() == 0
    assert [(r.length, r.ids_crc32) for r in pack(awkward_docs.where("doc_id = 3"), PATH).collect()] == [(1, zlib.crc32(np.array([1], "<u4").tobytes()))]


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u3000", " \n"])
def test_long_white_space(spark, blank):
    """Runs far beyond what the fast encoder's split can take give the library's identifiers."""
    text = "x" + blank * (2_000_000 // len(blank)) + "x"
    ids = np.array([*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1], "<u4")
    pieces = pack(spark.createDataFrame([(7, text, "a")], "doc_id long, text string, source string"), PATH).collect()
    assert sum(p.length for p in pieces) == len(ids)
    for p in pieces:
        assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
