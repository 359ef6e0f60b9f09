"""Operator 5: mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.bpe import PIECE_PATTERN, byte_characters
from linkloom.llm.mixing import source_key
from linkloom.llm.prefix import running_total
from linkloom.storage import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_key string"
#: Documents that a worker passes on together.
SLICE = 256


@dataclass(frozen=True)
class PackPlan:
    """``window`` is the tokens that one round over all queues serves; ``end_id`` closes each document.

    ``weights`` are target proportions that go to the sources in code-point order (null last),
    repeating; without them every source's target is its share of all tokens.
    """

    weights: Sequence[float] | None = None
    sequence: int = 2048
    window: int = 64 * 2048
    end_id: int = 1
    buckets: int = 4096


class Encoder:
    """Token identifiers of whole texts, those that the tokenizers library gives for the file.

    tiktoken does the merging over the file's own vocabulary, in less than half of the library's
    time; a sample of texts is held against the library when a worker loads the file. Its split
    backtracks over white space and gives up on very long runs, so texts that hold one are left
    to the library itself.
    """

    PROOF = "Proof: it's 12,345 wörds\n\n  of \t prose... <|endoftext|> 日本 \U0001f600 don't!!"

    LONG_BLANK = re.compile(r"(?<!\s)\s{10000}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("file", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.width = np.dtype("<u2" if self.engine.max_token_value < 1 << 16 else "<u4")
        self.library = Tokenizer.from_file(path)
        if self.engine.encode(self.PROOF, allowed_special=self.special) != self.library.encode(self.PROOF, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level BPE that merges by identifier")

    def encode(self, text: str) -> bytes:
        """Identifiers, little-endian, ``width`` each; special strings inside a text are their tokens."""
        if self.LONG_BLANK.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.engine.encode(text, allowed_special=self.special, disallowed_special=())
        return np.array(ids, self.width).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Counts and identifiers in place of texts, passed on in slices so that a worker holds few of them."""
    enc = encoder(vocabulary)
    end = np.array([end_id], enc.width).tobytes()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            ids = [enc.encode(t.as_py() or "") + end for t in batch["text"]]
            counts = pa.array([len(x) // enc.width.itemsize for x in ids], pa.int64())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), counts, pa.array(ids, pa.binary())], [*kept, "n", "ids"])


def _joined(places: list[dict]) -> list[dict]:
    """Neighbouring cuts that stand in one sequence without a gap, as one."""
    out: list[dict] = []
    for p in places:
        last = out[-1] if out else None
        if last and last["sequence_id"] == p["sequence_id"] and last["start"] + last["length"] == p["start"] and last["offset"] + last["length"] == p["offset"]:
            last["length"] += p["length"]
        else:
            out.append(p)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their checksums, from each document's identifiers and cuts."""
    names = ("start", "length", "ids_crc32", "sequence_id", "offset")
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            out: list[tuple] = []
            for doc_id, key, n, raw, places in zip(*(batch[c] for c in ("doc_id", "source_key", "n", "ids", "cuts")), strict=True):
                doc_id, key, n, raw = doc_id.as_py(), key.as_py(), n.as_py(), raw.as_py()
                words = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                for p in _joined(places.as_py()):
                    p["ids_crc32"] = zlib.crc32(words[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes())
                    out.append((doc_id, *(p[c] for c in names[:3]), n, *(p[c] for c in names[3:]), key))
            kinds = [pa.int64()] * 7 + [pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_key"])


def served_order(queued: DataFrame, plan: PackPlan, shares: Mapping[str | None, float] | None = None, ordered: bool = False) -> DataFrame:
    """Deficit round-robin: adds ``window`` and ``place``, the tokens that all queues sent before.

    ``queued`` has ``source_key``, ``__bucket``, ``__row`` and ``n`` (tokens). A queue sends packets of
    at most one sequence; each round adds to its deficit the window's tokens times its share, and
    it sends packets while the deficit covers them, carrying the rest over. So a packet that ends
    at token e of its queue leaves in the first round r with r * quantum >= e: a closed form
    that needs no state passed between tasks, and in which deficits carry across windows and
    partitions alike. ``shares``, or the plan's weights, hold while their queues last, after which
    the queues that remain divide the window in proportion: that is the tail, in which targets
    can't be met as there is nothing left to meet them with.

    If ``ordered``, buckets and keys are one order of all rows, and without targets a queue's
    quantum in a window is what it holds of the window's tokens in that order: a packet leaves
    in the round of the window that its last token falls into.

    Ties are settled by ``__key`` and ``__row``, which must be unique; ``n`` is at least 1 and no
    column is null; an empty table gives no rows; other columns play no part.
    """
    targets = shares is not None or plan.weights is not None
    if ordered and not targets:
        everything = queued.withColumn("__all", F.lit(0))
        tape = running_total(everything, ["__all"], "__bucket", ["__key", "__row"], "n", "__tape").drop("__all")
        return _placed(_packets(tape, plan), lambda end: end / plan.window, plan)
    totals = queued.groupBy("source_key").agg(F.sum("n").alias("__queue"))
    tape = running_total(queued, ["source_key"], "__bucket", ["__key", "__row"], "n", "__tape")
    if not targets:
        everything = F.sum("__queue").over(Window.partitionBy())
        rounds = totals.withColumn("__per_token", everything.cast("double") / F.col("__queue") / plan.window)
        served = lambda end: end * F.col("__per_token")
    else:
        rounds, served = _drained(totals, shares, plan)
    return _placed(_packets(tape.join(rounds, "source_key"), plan), served, plan)


def _packets(tape: DataFrame, plan: PackPlan) -> DataFrame:
    """Each row once for every packet of at most one sequence, with its ``start`` and ``length``."""
    packets = tape.select(
        "__row", "source_key", "n", "__tape", *[c for c in tape.columns if c.startswith("__per") or c == "__share"],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(plan.sequence).cast("long"))).alias("start"),
    )
    return packets.withColumn("length", F.least(F.lit(plan.sequence), F.col("n") - F.col("start")).cast("long"))


def _placed(packets: DataFrame, served: Callable[[Column], Column], plan: PackPlan) -> DataFrame:
    """Packets with their windows and places; ``served`` tells the rounds by which a token of the tape is sent."""
    end = F.col("__tape") + F.col("start") + F.col("length")
    sent = packets.select(
        "__row", "source_key", "start", "length", (F.col("__tape") + F.col("start")).alias("__at"),
        F.greatest(F.lit(0), F.ceil(served(end)) - 1).cast("long").alias("window"),
    )
    # Windows hold a bounded number of tokens; their own running total goes over blocks of 1024.
    held = sent.groupBy("window").agg(F.sum("length").alias("__held")).withColumn("__block", F.floor(F.col("window") / 1024))
    held = running_total(held.withColumn("__all", F.lit(0)), ["__all"], "__block", ["window"], "__held", "__earlier").select("window", "__earlier")
    inside = Window.partitionBy("window").orderBy("source_key", "__at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sent.withColumn("__inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .join(held, "window")
        .select("__row", "source_key", "start", "length", "window", (F.col("__earlier") + F.col("__inside")).alias("place"))
    )


def _drained(totals: DataFrame, shares: Mapping[str | None, float] | None, plan: PackPlan) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Rounds for target shares: the level v = token / share at which queues run dry, in turn.

    All tokens sent by level v are sum(min(queue, share * v)), piecewise linear with a knot per
    source. The knots are one value of the plan, a pair of numbers per source.
    """
    if shares is not None:
        key = lambda s: "1" if s is None else f"0{s}"
        if any(v <= 0 for v in shares.values()):
            raise ValueError("shares must be positive")
        told = totals.sparkSession.createDataFrame([(key(s), float(v)) for s, v in shares.items()], "source_key string, __share double")
        rated = written(totals.join(told, "source_key", "left"), "pack-shares")
        if rated.where("__share is null").limit(1).count():
            raise ValueError("every source needs a share")
    else:
        weights = F.array(*(F.lit(float(w)) for w in plan.weights))
        nth = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(plan.weights) + 1
        rated = written(totals.withColumn("__share", F.element_at(weights, nth)), "pack-shares")
    knots = rated.agg(F.sort_array(F.collect_list(F.struct(F.col("__queue").cast("double").alias("queue"), F.col("__share").alias("share"))))).scalar()

    def served(end: Column) -> Column:
        level = end / F.col("__share")
        return F.aggregate("__per_level", F.lit(0.0), lambda acc, k: acc + F.least(k["queue"], k["share"] * level)) / plan.window

    return rated.withColumn("__per_level", knots), served


def pack(docs: DataFrame, vocabulary: str, plan: PackPlan = PackPlan(), shares: Mapping[str | None, float] | None = None, id_col: str = "doc_id", order: Column | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``source_key``.

    Each document is its token identifiers and ``end_id``; queues are served by deficit
    round-robin (see ``served_order``) into one stream that is cut every ``sequence`` tokens. Every
    sequence but the last is full, so padding is less than one sequence in all.

    Without an ``order`` queues run by a digest of the id and every window has the target shares
    (those given, the plan's weights, or the sources' shares of the whole). With it (a whole number per row, not negative, such as ``stored_order`` gives)
    queues run by it and a window has the shares of its own stretch of that order.

    Null or empty texts are one piece with ``end_id`` alone; a null source is a queue of its own;
    rows that repeat an id are packed each; an empty table gives no rows; other columns are
    ignored. Texts are encoded once and the identifiers written to the shared folder; planning
    reads only counts, and identifiers move in one shuffle, to meet their cuts.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col("source")).alias("source_key"), F.col("text").cast("string").alias("text"), *([] if order is None else [order.cast("long").alias("__order")]))
    ranked = "" if order is None else "__order long, "
    coded = named.mapInArrow(lambda batches: _encoded(batches, vocabulary, plan.end_id), f"doc_id long, source_key string, {ranked}n long, ids binary")
    coded = written(coded.withColumn("__row", F.monotonically_increasing_id()), "pack")
    spread = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7))
    bucket, key = (F.pmod(spread, F.lit(plan.buckets)).cast("int"), spread) if order is None else (F.shiftright("__order", 10), F.col("__order"))
    queued = coded.select("source_key", "__row", "n", bucket.alias("__bucket"), key.alias("__key"))
    placed = served_order(queued, plan, shares, ordered=order is not None)
    first, last = F.floor(F.col("place") / plan.sequence), F.floor((F.col("place") + F.col("length") - 1) / plan.sequence)
    cuts = placed.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * plan.sequence)
    finish = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * plan.sequence)
    cuts = cuts.select(
        "__row",
        F.struct(
            (F.col("start") + begin - F.col("place")).alias("start"), (finish - begin).alias("length"),
            "sequence_id", (begin - F.col("sequence_id") * plan.sequence).alias("offset"),
        ).alias("cut"),
    )
    by_doc = cuts.groupBy("__row").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    return coded.join(by_doc, "__row").select("doc_id", "source_key", "n", "ids", "cuts").mapInArrow(_cut, PIECES)
