"""Operator 10: toxicity by weak supervision."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.storage import discard, written

WORD = re.compile(r"[^\W\d_]+")
#: Prefix lengths beside whole words; inflected and compounded forms share them.
PREFIXES = (3, 4, 5, 6, 7)
TABLE = 1 << 20
#: Words a worker remembers the terms of; the store is emptied when full.
WORD_STORE = 300_000
#: Stands for the number of words of a text, beside the hashed terms: the same evidence weighs less in a long text.
SIZE_TERM = TABLE

WORD_LEXICONS, PREFIX_LEXICONS = 8, 6
PATTERNS = ("several terms", "often", "dense", "several prefixes", "shouting", "exclaiming", "addressed", "no word", "no prefix", "neither", "lone")
VOTERS = WORD_LEXICONS + PREFIX_LEXICONS + len(PATTERNS)


@dataclass(frozen=True)
class ToxicPlan:
    """Bounds of what is fitted; scoring covers every document.

    ``most_labelled``: the labelled training rows, smallest id digest first, that lexicons, label
    model and classifier are fitted on, ``most_bytes`` of packed terms at most. ``features``: terms
    the classifier may use.
    """

    most_labelled: int = 20_000
    most_bytes: int = 192 << 20
    features: int = 8192
    folds: int = 5
    least_support: int = 4
    lexicon_share: float = 0.8
    rounds: int = 40
    ridge: float = 3e-4


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


# -- terms ----------------------------------------------------------------------------------


class _Terms(dict):
    """Words to their hashed terms: the word itself, then its prefixes."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_STORE:
            self.clear()
        keys = [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]
        found = self[word] = tuple(zlib.crc32(k.encode()) % TABLE for k in keys)
        return found


_terms = _Terms()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def term_counts(text: str, chosen: frozenset[int] | None = None) -> dict[int, int]:
    """How many words of a text carry each hashed term."""
    counts: dict[str, int] = {}
    for w in words_of(text):
        counts[w] = counts.get(w, 0) + 1
    out: dict[int, int] = {SIZE_TERM: sum(counts.values())}
    for w, n in counts.items():
        for t in _terms[w]:
            if chosen is None or t in chosen:
                out[t] = out.get(t, 0) + n
    return out


def term_value(count: np.ndarray | int):
    """A term's weight in a text grows with the logarithm of its count."""
    return np.log2(1.0 + count)


@dataclass
class Lexicon:
    """Hashed terms that labelled training rows tie to toxicity."""

    words: frozenset[int]
    prefixes: frozenset[int]


def votes(text: str, lexicon: Lexicon) -> list[int]:
    """One vote per voter: 1 toxic, -1 not, 0 abstains."""
    words = words_of(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    out = [0] * VOTERS
    hits, distinct, stems, marked = 0, 0, set(), 0
    for w, n in counts.items():
        first, *rest = _terms[w]
        if first in lexicon.words:
            hits += n
            distinct += 1
            out[first % WORD_LEXICONS] = 1
        marked += n if first in lexicon.words or any(p in lexicon.prefixes for p in rest) else 0
        for p in rest:
            if p in lexicon.prefixes:
                stems.add(p)
                out[WORD_LEXICONS + p % PREFIX_LEXICONS] = 1
    at = WORD_LEXICONS + PREFIX_LEXICONS
    size, letters = max(1, len(words)), max(1, sum(map(str.isalpha, text)))
    out[at] = 1 if distinct >= 2 else 0
    out[at + 1] = 1 if marked >= 3 else 0
    out[at + 2] = 1 if marked / size >= 0.01 and marked >= 2 else 0
    out[at + 3] = 1 if len(stems) >= 2 else 0
    out[at + 4] = 1 if distinct and sum(map(str.isupper, text)) / letters > 0.3 else 0
    out[at + 5] = 1 if distinct and text.count("!") >= 3 else 0
    out[at + 6] = 1 if distinct and any(w in counts for w in ("you", "your", "du", "tu", "tú", "vous", "usted")) else 0
    out[at + 7] = -1 if not distinct else 0
    out[at + 8] = -1 if not stems else 0
    out[at + 9] = -1 if not marked else 0
    out[at + 10] = -1 if marked == 1 and size > 60 else 0
    return out


# -- fitting --------------------------------------------------------------------------------


def lexicon_from(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, plan: ToxicPlan) -> np.ndarray:
    """Terms whose share of toxic rows, each class weighted equally and smoothed, is high enough."""
    rate_pos, rate_neg = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    precise = pos / np.maximum(1, pos + neg)
    return np.flatnonzero((pos >= plan.least_support) & (rate_pos / (rate_pos + rate_neg) >= 0.9) & (precise >= plan.lexicon_share))


@dataclass
class LabelModel:
    """P(vote | class) per voter, a class prior, and a weight per voter for what it repeats of others."""

    tables: np.ndarray  # voters x 2 x 3, votes -1, 0, 1
    prior: float
    weights: np.ndarray
    correlations: np.ndarray = field(repr=False, default=None)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables)
        gap = logs[:, 1, :] - logs[:, 0, :]
        total = np.log(self.prior / (1 - self.prior)) + (gap[np.arange(cast.shape[1])[None, :], cast + 1] * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_label_model(cast: np.ndarray, prior: float, rounds: int) -> LabelModel:
    """Expectation maximisation over votes alone, started from their majority.

    Accuracies are P(vote | class); correlations are those of the votes' residuals given the
    class. A voter's evidence counts by one over one plus its squared correlations with the
    others, so that voters that repeat each other don't add up.
    """
    rows, voters = cast.shape
    score = cast.clip(0, 1).sum(1) - (cast < 0).sum(1)
    q = np.where(score > 0, 0.9, np.where(score < 0, 0.02, prior))
    model = LabelModel(np.full((voters, 2, 3), 1 / 3), prior, np.ones(voters))
    onehot = np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        mass = np.stack([1 - q, q])
        tables = np.einsum("cr,rvk->vck", mass, onehot) + 0.5
        model.tables = tables / tables.sum(axis=2, keepdims=True)
        mean = model.tables @ np.array([-1.0, 0.0, 1.0])
        residual = cast - (mean[:, 0][None, :] * (1 - q)[:, None] + mean[:, 1][None, :] * q[:, None])
        cov = residual.T @ residual / max(1, rows)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        model.correlations = cov / scale[:, None] / scale[None, :]
        np.fill_diagonal(model.correlations, 0)
        model.weights = 1 / (1 + (model.correlations**2).sum(axis=1))
        fresh = model.posterior(cast)
        if np.abs(fresh - q).max() < 1e-6:
            break
        q = fresh
    return model


def fit_linear(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, d: int, target: np.ndarray, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on sparse features, by conjugate directions with backtracking.

    ``starts`` says where each row's features begin in ``columns`` and ``values``; no row is without any.
    """
    n, block = len(starts), 1024
    ends = np.append(starts[1:], len(columns))

    def loss_and_slope(w: np.ndarray, b: float):
        z, slope = np.empty(n), ridge * w
        for at in range(0, n, block):  # in blocks, so that only a few rows' products are held
            a, e = starts[at], ends[min(n, at + block) - 1]
            z[at : at + block] = np.add.reduceat(w[columns[a:e]] * values[a:e], starts[at : at + block] - a) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        gap = (p - target) / n
        for at in range(0, n, block):
            a, e = starts[at], ends[min(n, at + block) - 1]
            many = ends[at : at + block] - starts[at : at + block]
            slope = slope + np.bincount(columns[a:e], np.repeat(gap[at : at + block], many) * values[a:e], d)
        return (np.logaddexp(0, z) - target * z).mean() + ridge / 2 * (w @ w), slope, gap.sum()

    w, b, rate = np.zeros(d), 0.0, 1.0
    loss, gw, gb = loss_and_slope(w, b)
    dw, db = -gw, -gb
    for _ in range(steps):
        slope = gw @ dw + gb * db
        if slope >= 0:
            dw, db, slope = -gw, -gb, -(gw @ gw + gb * gb)
        if -slope < 1e-14:
            break
        while True:
            new, ngw, ngb = loss_and_slope(w + rate * dw, b + rate * db)
            if new <= loss + 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        w, b = w + rate * dw, b + rate * db
        turn = max(0.0, (ngw @ (ngw - gw) + ngb * (ngb - gb)) / max(1e-300, gw @ gw + gb * gb))
        dw, db = -ngw + turn * dw, -ngb + turn * db
        loss, gw, gb, rate = new, ngw, ngb, rate * 2
    return w, b


@dataclass
class Scorer:
    """A linear classifier over hashed terms, as its nonzero weights."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.index.tolist(), self.weight.tolist(), strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, how many toxic and other rows hold each term, for the terms that occur."""
    counts = np.zeros((2, TABLE), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[toxic, np.fromiter((t for t in term_counts(text or "") if t != SIZE_TERM), np.int64)] += 1
    found = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(found), 100_000):
        some = found[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["term", "neg", "pos"])


def _voted(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, index: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Votes, and the chosen terms as places in ``index`` and their values, packed: two and four bytes a term."""
    chosen = frozenset(index.tolist())
    for batch in batches:
        cast, places, values = [], [], []
        for text in batch["text"].to_pylist():
            cast.append(np.array(votes(text or "", lexicon), np.int8).tobytes())
            found = term_counts(text or "", chosen)
            terms = np.fromiter(found, np.int64, len(found))
            order = np.argsort(terms)
            places.append(np.searchsorted(index, terms[order]).astype("<u2").tobytes())
            values.append(term_value(np.fromiter(found.values(), np.int64, len(found))[order]).astype("<f4").tobytes())
        columns = [pa.array(c, pa.binary()) for c in (cast, places, values)]
        yield pa.RecordBatch.from_arrays([batch["spread"], batch["doc_id"], *columns], ["spread", "doc_id", "votes", "places", "values"])


def fit(docs: DataFrame, labels: DataFrame, plan: ToxicPlan = ToxicPlan()) -> tuple[Scorer, LabelModel | None]:
    """Lexicons, label model and classifier from labelled rows outside the held-out fold.

    Only what the bounded sample holds is gathered: the summed counts of terms that enough rows
    hold, of at most ``TABLE`` hashed ones, then votes and chosen terms of at most ``most_labelled`` rows, six bytes for each of at most ``features``
    terms of a row and stopped at ``most_bytes`` in all. Rows beyond that are not fitted on, in
    the order of their digests, so that the bound does not depend on how long texts are.
    """
    if plan.features >= 1 << 16:
        raise ValueError("too many features")
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), plan.folds) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.most_labelled)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # Of rows that repeat an id one is taken, so the sample keeps its bound.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", F.xxhash64("doc_id").alias("spread"), "doc_id").repartition(32, "doc_id").persist()
    try:
        n_neg, n_pos = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
        summed = sample.mapInArrow(_counted, "term long, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        # Terms of fewer rows are in no lexicon and no feature.
        told = summed.where(F.col("neg") + F.col("pos") >= plan.least_support).toArrow()
        neg, pos = np.zeros(TABLE, np.int64), np.zeros(TABLE, np.int64)
        neg[told["term"].to_numpy()], pos[told["term"].to_numpy()] = told["neg"].to_numpy(), told["pos"].to_numpy()
        if not n_pos or not n_neg:
            rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
            return Scorer(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate)))), None
        terms = lexicon_from(pos, neg, n_pos, n_neg, plan)
        chosen_terms = frozenset(terms.tolist())
        lexicon = Lexicon(chosen_terms, chosen_terms)
        spread = np.abs(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))) * np.sqrt(np.minimum(pos / n_pos + neg / n_neg, 0.2)) * (pos + neg >= plan.least_support)
        order = np.lexsort((np.arange(TABLE), -spread))[: plan.features]
        index = np.append(np.sort(order[spread[order] > 0]), SIZE_TERM)
        voted = written(sample.mapInArrow(lambda batches: _voted(batches, lexicon, index), "spread long, doc_id long, votes binary, places binary, values binary"), "votes")
        # The same order on every run; rows arrive one partition at a time and are kept packed.
        cast, places, values, held = [], [], [], 0
        for r in voted.orderBy("spread", "doc_id").toLocalIterator():
            held += len(r["places"]) + len(r["values"])
            if held > plan.most_bytes and cast:
                break
            cast.append(np.frombuffer(r["votes"], np.int8))
            places.append(np.frombuffer(r["places"], "<u2"))
            values.append(np.frombuffer(r["values"], "<f4"))
        discard(voted)
    finally:
        sample.unpersist()
    cast = np.stack(cast)
    model = fit_label_model(cast, n_pos / (n_pos + n_neg), plan.rounds)
    target = model.posterior(cast)
    starts = np.cumsum([0, *(len(p) for p in places)])[:-1]
    weight, bias = fit_linear(starts, np.concatenate(places), np.concatenate(values), len(index), target, plan.ridge)
    some = np.flatnonzero(np.abs(weight) > 1e-4)
    return Scorer(index[some], weight[some], bias), model


def scored(text: Column, scorer: Scorer) -> Column:
    weights, bias = scorer.table(), scorer.bias
    chosen = frozenset(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        marks: dict[str, tuple[int, ...]] = {}
        out = np.empty(len(texts))
        for i, t in enumerate(texts.to_pylist()):
            words = words_of(t or "")
            counts = {SIZE_TERM: len(words)} if SIZE_TERM in chosen else {}
            for w in words:
                mine = marks.get(w)
                if mine is None:
                    mine = marks[w] = tuple(x for x in _terms[w] if x in chosen)
                for x in mine:
                    counts[x] = counts.get(x, 0) + 1
            out[i] = bias + sum(weights[x] * float(term_value(n)) for x, n in sorted(counts.items()))
        return pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return score(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, plan: ToxicPlan = ToxicPlan()) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Voters are lexicons of words and of word beginnings, found in labelled training rows, and
    patterns; a generative model of their votes gives posterior labels, and a linear classifier
    learns those from terms. A score depends on the text alone.

    Null texts are scored like empty ones, by the bias; null ids are in fold 0 or not as the
    empty text's checksum says; repeated rows score alike; an empty table gives no rows, and
    without usable labels of both kinds every score is the smoothed rate. Other columns are
    ignored. Scoring is one pass over whole texts without a shuffle.
    """
    scorer, _ = fit(docs, labels, plan)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), plan.folds) == 0).alias("held_out"), scored(F.col("text"), scorer).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
