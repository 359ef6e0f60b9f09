"""Operator 8: n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.groups import grouped
from linkloom.storage import broadcast_if_small, discard, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Numerator and denominator of the least similarity are kept as integers, so that ties at it are exact.
SKETCH = "struct<digest: binary, bands: array<long>, signature: binary, n_words: long, words: binary>"
#: A band's key is its hash with its number in the lowest bits.
BAND_BITS = 7


@dataclass(frozen=True)
class JoinPlan:
    """Similarity at least ``times``/``of`` over ``n``-word n-grams.

    ``recall`` is that of banding for a pair exactly at the threshold; ``hashes`` the most
    signature entries. Candidates of a band whose signatures agree by less than the threshold
    less ``slack`` (four standard errors at 120 entries) are not followed. ``block`` and
    ``block_words`` bound what one task compares at a time.
    """

    n: int = 5
    times: int = 4
    of: int = 5
    recall: float = 0.9999
    hashes: int = 128
    slack: float = 0.15
    block: int = 512
    block_words: int = 2_000_000

    @property
    def shape(self) -> tuple[int, int]:
        """(bands, rows): the most rows a band may have while the recall is met within ``hashes``."""
        t, best = self.times / self.of, None
        for rows in range(1, self.hashes + 1):
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - t**rows)) if t < 1 else 1
            if bands * rows <= self.hashes:
                best = bands, rows
        if best is None:
            raise ValueError("the recall can't be met with so few hashes")
        return best


# -- sketches -------------------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def _constants(n: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240 + n)
    odd = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(n), odd(hashes), rng.integers(0, 2**63, hashes, dtype=np.uint64)


class _Ids(dict):
    """Words to whole numbers from 1, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        return number


def windows(ids: np.ndarray, starts: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """A whole number per window of ``n`` ids, equal exactly where the windows are equal.

    Ids run from 0 to ``vocabulary``. Windows are numbers in base ``vocabulary + 1``; before one
    would pass 63 bits, its prefixes are replaced by their ranks among those that occur.
    """
    base = vocabulary + 1
    code, width = ids[starts].astype(np.int64), base
    for k in range(1, n):
        if width > (1 << 63) // base - 1:
            known, code = np.unique(code, return_inverse=True)
            code, width = code.astype(np.int64), max(1, len(known))
        code = code * base + ids[starts + k]
        width *= base
    return code


def _padded(ids: np.ndarray, n: int) -> np.ndarray:
    """A text shorter than a window is a window of its own, closed by zeros, which no word has."""
    return ids if len(ids) >= n else np.append(ids, np.zeros(n - len(ids), np.int64))


def ngram_sketch(words: Sequence[str], n: int) -> tuple[np.ndarray, bytes]:
    """64-bit digests of a text's distinct runs of ``n`` words, and a digest of their exact set.

    The set's digest is a cryptographic one (128 bits) of the sorted vocabulary and of all runs as
    sorted numbers over it. Texts have equal sets exactly where both agree, as every word stands
    in some run.
    """
    vocabulary = sorted(set(words))
    place = {w: i + 1 for i, w in enumerate(vocabulary)}
    ids = _padded(np.fromiter(map(place.__getitem__, words), np.int64, len(words)), n)
    codes, at = np.unique(windows(ids, np.arange(len(ids) - n + 1), n, len(vocabulary)), return_index=True)
    exact = hashlib.blake2b("\n".join(vocabulary).encode(), digest_size=16)
    exact.update(b"\n\n")
    exact.update(codes.astype("<i8").tobytes())
    scale = _constants(n, 1)[0]
    own = np.fromiter((0, *(xxhash.xxh3_64_intdigest(w) for w in vocabulary)), np.uint64, len(vocabulary) + 1)[ids]
    mixed = np.zeros(len(at), np.uint64)
    for k in range(n):
        mixed += own[at + k] * scale[k]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return mixed, exact.digest()


def signature(grams: np.ndarray, n: int, hashes: int) -> np.ndarray:
    _, scale, shift = _constants(n, hashes)
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 1_000_000 // hashes)
    for at in range(0, len(grams), step):
        part = grams[None, at : at + step] * scale[:, None] + shift[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature_bytes(least: np.ndarray) -> bytes:
    """A byte per entry; as minima have few high bits, all are mixed into it."""
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(parts: np.ndarray) -> np.ndarray:
    """A key per band of a signature, different bands having different keys."""
    _, scale, _ = _constants(0, parts.shape[1])
    mixed = (parts * scale[None, :]).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed << np.uint64(BAND_BITS) | np.arange(len(parts), dtype=np.uint64)).view(np.int64)


def _sketched(text: Column, plan: JoinPlan) -> Column:
    bands, rows = plan.shape
    if bands > 1 << BAND_BITS:
        raise ValueError("too many bands")

    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        out, pack = [], zstandard.ZstdCompressor(level=1)
        for t in texts:
            words = WORDS.findall(t.as_py() or "")
            if not words:
                out.append(None)
                continue
            grams, digest = ngram_sketch(words, plan.n)
            sig = signature(grams, plan.n, bands * rows)
            out.append({"digest": digest, "bands": band_keys(sig.reshape(bands, rows)), "signature": signature_bytes(sig), "n_words": len(words), "words": pack.compress(" ".join(words).encode())})
        kind = pa.struct([("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("n_words", pa.int64()), ("words", pa.binary())])
        return pa.array(out, kind)

    return sketch(text.cast("string"))


# -- candidates -----------------------------------------------------------------------------


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member that each of n members is connected to."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _first_shared(bands: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share none of ``bands``, which are those before the group's own."""
    return ~(bands[a] == bands[b]).any(axis=1)


def _earlier(group: pa.Table) -> np.ndarray:
    return group["earlier"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The rows of a group that are half of a pair to be verified there.

    Such a pair's signatures agree enough, and the group's band is the first that the two share,
    so that no pair is verified in two bands.
    """
    for group in grouped(batches, "g"):
        n = group.num_rows
        if n < 2:
            continue
        within, own, bands = group["within"][0].as_py(), group["own"].to_numpy(), _earlier(group)
        sigs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(n, -1)
        enough = math.ceil(least * sigs.shape[1])
        needed = np.zeros(n, bool)
        step = max(1, 4_000_000 // (n * sigs.shape[1]))
        for at in range(0, n, step):
            i, j = np.nonzero((sigs[at : at + step, None, :] == sigs[None, at:, :]).sum(axis=2, dtype=np.int32) >= enough)
            i, j = i + at, j + at
            keep = (i < j) & (within | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            keep = _first_shared(bands, i, j)
            needed[i[keep]] = needed[j[keep]] = True
        if needed.any():
            yield from group.drop_columns(["signature"]).filter(pa.array(needed)).combine_chunks().to_batches()


def shared_bands(sketched: DataFrame, plan: JoinPlan) -> DataFrame:
    """(band, rep, n, blocks): each representative with the bands that it shares with n - 1 others.

    Copies, which share all their bands, collapse to their smallest row within each band, before
    the shuffle as far as a task sees them. A bucket is compared in so many blocks that each
    holds about ``block`` texts and ``block_words`` words.
    """
    bands = sketched.where(F.col("digest").isNotNull()).select(F.xxhash64("digest").alias("d"), "row", "n_words", F.explode("bands").alias("band"))
    single = bands.groupBy("band", "d").agg(F.min("row").alias("rep"), F.max("n_words").alias("n_words"))
    single = written(single.select("band", "rep", "n_words"), "ngram-bands")
    blocks = F.greatest(F.ceil(F.count("*") / plan.block), F.ceil(F.sum("n_words") / plan.block_words))
    shared = single.groupBy("band").agg(F.count("*").alias("n"), blocks.cast("long").alias("blocks")).where("n > 1")
    met = written(single.drop("n_words").join(shared, "band"), "ngram-shared")
    discard(single)
    return met


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks of its bucket that its own block is part of; ``g`` names the pair."""
    own = F.pmod(F.xxhash64(F.col("rep"), F.lit(3)), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(pair.alias("g"), "rep", "own", (F.col("own") == F.col("other")).alias("within"), *(c for c in rows.columns if c not in ("rep", "band", "n", "blocks")))


def candidates(shared: DataFrame, payload: DataFrame, plan: JoinPlan) -> DataFrame:
    """(g, rep, own, within, earlier): texts and the groups in which they have a pair to be verified.

    A group is a band's bucket, or a pair of blocks of one that is large. Only texts that share a
    band ever meet, and a text goes on to those groups alone where it has a partner that it has
    not met in an earlier band (``earlier`` holds those); what similar texts are linked to further
    on plays no part. ``rep`` is unique in ``payload`` and never null; empty tables give no rows;
    other columns are ignored.
    """
    number = F.col("band").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    rows = shared.join(payload.select("rep", "signature", "bands"), "rep").withColumn("earlier", F.slice("bands", F.lit(1), number)).drop("bands")
    dealt = _in_blocks(rows).repartition("g").sortWithinPartitions("g")
    least = plan.times / plan.of - plan.slack
    return dealt.mapInArrow(lambda batches: _alike(batches, least), "g long, rep long, own long, within boolean, earlier array<long>")


# -- verification ---------------------------------------------------------------------------


def overlaps(sets: Sequence[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, counted by n-gram.

    N-grams of many sets are multiplied as a matrix; those of few add one to each of their pairs.
    """
    n = len(sets)
    grams = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, int)
    sizes = np.diff(np.append(begin, len(grams)))
    common = np.zeros((n, n), np.float32)
    common[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    for size in range(2, min(16, n) + 1):
        members = owner[begin[sizes == size][:, None] + np.arange(size)]
        for a in range(size):
            for b in range(a + 1, size):
                np.add.at(common, (members[:, a], members[:, b]), 1)
    low = np.triu(common, 1)
    common = low + low.T + np.diag(np.diag(common))
    frequent = np.flatnonzero(sizes > min(16, n))
    for at in range(0, len(frequent), 4096):
        part = frequent[at : at + 4096]
        dense = np.zeros((n, len(part)), np.float32)
        for k, g in enumerate(part):
            dense[owner[begin[g] : begin[g] + sizes[g]], k] = 1
        counted = dense @ dense.T
        np.fill_diagonal(counted, 0)
        common += counted
    return common.astype(np.int64)


def exact_sets(texts: Sequence[Sequence[str]], n: int) -> list[np.ndarray]:
    """Each text's distinct runs of ``n`` words as numbers that stand for the runs exactly, in all texts alike."""
    known = _Ids()
    ids = [_padded(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), n) for words in texts]
    counts = np.array([len(i) - n + 1 for i in ids])
    begin = np.cumsum([0, *(len(i) for i in ids)])[:-1]
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counts, strict=True)])
    codes = windows(np.concatenate(ids), starts, n, len(known))
    return [np.unique(part) for part in np.split(codes, np.cumsum(counts)[:-1])]


def _verified(batches: Iterator[pa.RecordBatch], plan: JoinPlan) -> Iterator[pa.RecordBatch]:
    """Per member of a group: the copies it links to there, and an edge to its least linked member.

    Sets of whole words are compared. In a pair of two blocks only links between them count, also
    where one of them is empty, and in each band only links between texts that share none before.
    """
    unpack = zstandard.ZstdDecompressor()
    for group in grouped(batches, "g"):
        n = group.num_rows
        if n < 2:
            continue
        within, bands = group["within"][0].as_py(), _earlier(group)
        ids, own, copies = (group[c].to_numpy() for c in ("rep", "own", "copies"))
        sets = exact_sets([unpack.decompress(w).decode().split(" ") for w in group["words"].to_pylist()], plan.n)
        size = np.array([len(s) for s in sets])
        shared = overlaps(sets)
        # shared / (a + b - shared) >= times / of
        linked = np.triu(shared * (plan.of + plan.times) >= plan.times * (size[:, None] + size[None, :]), 1)
        if not within:
            linked &= own[:, None] != own[None, :]
        a, b = np.nonzero(linked)
        first = _first_shared(bands, a, b)
        a, b = a[first], b[first]
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        root = _roots(n, np.stack([a, b], 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])], ["u", "links", "v"])


#: Rows of up to so many ids are broadcast (8 bytes each); beyond, those joins are shuffled.
BROADCAST_IDS = 2_000_000


def _sketch_table(docs: DataFrame, plan: JoinPlan, carried: Sequence[str] = ()) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _sketched(F.col("text"), plan).alias("s"), *carried)
    return written(named.select("doc_id", "row", *carried, "s.*"), "ngrams")


def _classes(sketched: DataFrame, plan: JoinPlan) -> DataFrame:
    """(row, doc_id, class_id, n_links, first) for every row of the sketch table."""
    shared = shared_bands(sketched, plan)
    involved = broadcast_if_small(written(shared.select("rep").distinct(), "ngram-involved"), BROADCAST_IDS)
    known = sketched.where(F.col("digest").isNotNull()).select("doc_id", "row", "digest")
    held = written(known.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")), "ngram-copies")
    payload = written(sketched.select(F.col("row").alias("rep"), "signature", "bands", "words").join(involved, "rep").join(held.select("rep", "copies"), "rep"), "ngram-payload")
    met = written(candidates(shared, payload, plan), "ngram-candidates")
    discard(shared)
    dealt = met.join(payload.drop("signature", "bands"), "rep").repartition("g").sortWithinPartitions("g")
    checked = written(dealt.mapInArrow(lambda batches: _verified(batches, plan), "u long, links long, v long"), "ngram-links")
    discard(payload, met)
    links = checked.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(checked.where("u <> v").select("u", "v")).select(F.col("node").alias("rep"), "label")

    classed = written(held.join(links, "rep", "left").join(classes, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "ngram-classed")
    # The smallest id of each class is found among representatives, so no row is dealt by its class.
    best = classed.groupBy("label").agg(F.min("best").alias("__least")).select("label", F.col("__least.doc_id").alias("class_id"), F.col("__least.row").alias("kept"))
    resolved = classed.join(best, "label").select("digest", "class_id", "kept", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    told = known.join(resolved, "digest").select("row", "doc_id", "class_id", "n_links", (F.col("kept") == F.col("row")).alias("first"))
    without = sketched.where(F.col("digest").isNull()).select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return told.unionByName(without)


def jaccard_classes(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``n_links`` and ``first`` (the one of its class to keep).

    Documents link if their sets of ``n``-word n-grams (words as split by ASCII white space) have
    at least the plan's Jaccard similarity. ``n_links`` counts a document's partners, copies
    included; a class is what links connect, and its id the smallest ``doc_id`` in it.

    A text of fewer than ``n`` words is a single n-gram; null texts and texts without words link
    to nothing and are classes of their own. Repeated rows are copies of each other; with null
    ids a class's id comes from the others. An empty table gives no rows; other columns are
    ignored.

    Copies (equal sets) are first collapsed to one representative, so hot groups of copies weigh
    nothing afterwards; band buckets are compared in blocks; pairs are verified on their whole
    words in the first band that they share, counted there, and never become rows. Texts move
    only to buckets in which they have a partner to be verified.
    """
    return _classes(_sketch_table(docs, plan), plan).drop("row")


def first_of_classes(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id, of repeated rows any one.

    Texts without words all stay. Texts are written once beside their sketches; the rows to
    leave out are broadcast while they are few, so that texts are shuffled only beyond that.
    """
    whole = "__document"
    sketched = _sketch_table(docs.withColumn(whole, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), plan, [whole])
    removed = written(_classes(sketched.drop(whole), plan).where(~F.col("first")).select("row"), "ngram-removed")
    return sketched.select("row", whole).join(broadcast_if_small(removed, BROADCAST_IDS), "row", "left_anti").select(f"{whole}.*")
