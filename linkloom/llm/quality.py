"""Operator 7: quality rules and robust multivariate outliers. Native DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.mixing import source_key
from linkloom.storage import broadcast_if_small, checkpointed, written

#: ASCII white space, which separates words; and the symbols counted.
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Estimates of up to so many (language, source) groups, about 200 bytes each, are broadcast.
BROADCAST_GROUPS = 50_000

#: The transformed statistics, in order.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals")


@dataclass(frozen=True)
class OutlierPlan:
    """``half`` of a group's rows fix its estimate; smaller groups than ``least_rows`` share one.

    ``spread_floor`` is the least standard deviation of each transformed statistic: statistics
    that are nearly constant in clean text (no symbols, no repeated lines) would otherwise make
    any departure infinitely far. Every start takes ``trial_steps`` concentration steps; the one
    with the least determinant goes on until no determinant's logarithm moves by more than
    ``settled``, ``steps`` at most in all. A row is rejected if its squared distance passes the
    chi-square quantile ``keep``.
    """

    half: float = 0.75
    trial_steps: int = 2
    steps: int = 12
    settled: float = 1e-6
    least_rows: int = 60
    spread_floor: Sequence[float] = (0.08, 0.35, 0.35, 0.35, 0.35)
    keep: float = 1 - 1e-6


# -- statistics of a text -------------------------------------------------------------------


def text_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals.

    Each text is split once; windows of five words are compared by 64-bit digests within their
    own document, so nothing is shuffled.
    """
    blank = F.lit("")
    staged = docs.withColumn("__text", F.coalesce(text.cast("string"), blank))
    staged = staged.withColumn("__words", F.filter(F.split("__text", SPLIT), lambda w: w != ""))
    staged = staged.withColumn("__n", F.size("__words")).withColumn("__digests", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.when(
        F.col("__n") >= 5,
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__n") - 4)), lambda i: F.xxhash64(*(F.element_at("__digests", i + k) for k in range(5)))),
    ).otherwise(F.array().cast("array<bigint>"))
    staged = staged.withColumn("__windows", windows).withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    staged = staged.withColumn("__twice", F.size("__windows") > F.size(F.array_distinct("__windows")))
    placed = F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    staged = staged.withColumn("__placed", F.when(F.col("__twice"), placed))
    staged = staged.withColumn("__hits", F.when(F.col("__twice"), _covered("__placed")))
    return staged.select(
        *docs.columns,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce("__hits", F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def _covered(placed: str) -> Column:
    """Words inside windows that occur twice or more, from windows sorted by digest."""
    n = F.size(placed)
    repeated = F.filter(
        placed,
        lambda e, i: ((i > 0) & (F.get(placed, i - 1)["w"] == e["w"])) | ((i < n - 1) & (F.get(placed, i + 1)["w"] == e["w"])),
    )
    at = F.array_sort(F.transform(repeated, lambda e: e["i"]))
    # A window covers five words, less those that the next repeated window starts over.
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def transformed() -> list[Column]:
    """The statistic vector: logarithms of shares, with constants that steady short texts."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [
        F.log((chars + 25.0) / (words + 5.0)),
        F.log(0.01 + F.col("n_symbols") / (chars + 50.0)),
        F.log(0.05 + F.col("n_dup_lines") / (F.col("n_lines") + 2.0)),
        F.log(0.05 + F.col("n_repeat_words") / (words + 20.0)),
        F.log(0.05 + F.col("n_capitals") / (chars + 50.0)),
    ]


# -- minimum covariance determinant ---------------------------------------------------------


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 10.0 * d + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def chi_square_cdf(x: float, d: int) -> float:
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def _factor(cov: list[list[Column]]) -> list[list[Column]]:
    """Lower Cholesky factor, written out as expressions."""
    d = len(cov)
    low: list[list[Column]] = [[F.lit(0.0)] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - low[i][k] * low[j][k], range(j), cov[i][j])  # noqa: B023
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / low[j][j]
    return low


def _distance(values: list[Column], center: Sequence[Column], factor: Sequence[Sequence[Column]]) -> list[Column]:
    """The solution of factor * z = value - center; its squared length is the squared distance."""
    solved: list[Column] = []
    for i, v in enumerate(values):
        rest = reduce(lambda a, k: a - factor[i][k] * solved[k], range(i), v - center[i])  # noqa: B023
        solved.append(rest / factor[i][i])
    return solved


def _estimates(sums: DataFrame, keys: Sequence[str], floor: Sequence[float], scale: float) -> DataFrame:
    """Centers and factors (``m0``.. and ``c00``..) from ``n``, ``s0``.. and ``p00``.. per key."""
    d = len(floor)
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n for i in range(d)]
    staged = sums.select(*keys, *(mean[i].alias(f"m{i}") for i in range(d)), *((F.col(f"p{i}{j}") / n).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)))
    cov = [[(F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (floor[i] ** 2 if i == j else 0.0) for j in range(i + 1)] for i in range(d)]
    return _with_factor(staged, keys, cov, d)


def _with_factor(staged: DataFrame, keys: Sequence[str], cov: list[list[Column]], d: int) -> DataFrame:
    """Factor columns added one row at a time, so that no expression repeats an earlier one."""
    out = staged
    for i in range(d):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(j), cov[i][j])  # noqa: B023
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c{j}{j}"))
    return out.select(*keys, *(f"m{i}" for i in range(d)), *(f"c{i}{j}" for i in range(d) for j in range(i + 1)))


def estimate_keys(rows: DataFrame, plan: OutlierPlan) -> DataFrame:
    """(lang, source) keys to the key of the estimate they use: of their own rows if enough, else the language's, else all."""
    counts = rows.groupBy("lang_key", "group_key").agg(F.count("*").alias("n"))
    of_lang = F.sum("n").over(Window.partitionBy("lang_key"))
    own = F.when(F.col("n") >= plan.least_rows, F.concat(F.lit("g"), "group_key"))
    return counts.select("lang_key", "group_key", F.coalesce(own, F.when(of_lang >= plan.least_rows, F.concat(F.lit("l"), "lang_key")), F.lit("all")).alias("key"))


def pools(keys: DataFrame) -> DataFrame:
    """(group_key, key) for every estimate that some group uses and each group whose rows it is made from."""
    every = F.array(F.concat(F.lit("g"), "group_key"), F.concat(F.lit("l"), "lang_key"), F.lit("all"))
    return keys.select("group_key", F.explode(every).alias("key")).join(keys.select("key").distinct(), "key", "left_semi")


def _first(rows: DataFrame, keys: DataFrame, floor: Sequence[float]) -> DataFrame:
    """A deterministic start: medians and quartile spreads from counts of values rounded to 1/64."""
    d = len(floor)
    long = rows.select("group_key", F.posexplode(F.array(*(F.floor(F.col(f"f{i}") * 64).cast("long") for i in range(d)))).alias("i", "bin"))
    counts = long.groupBy("group_key", "i", "bin").agg(F.count("*").alias("n")).join(keys, "group_key").groupBy("key", "i", "bin").agg(F.sum("n").alias("n"))
    per = Window.partitionBy("key", "i")
    ranked = counts.select("key", "i", "bin", F.sum("n").over(per.orderBy("bin")).alias("upto"), F.sum("n").over(per).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) / 64.0))
    quartiles = ranked.groupBy("key", "i").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    spread = F.greatest((F.col("c") - F.col("a")) / 1.349, F.element_at(F.array(*map(F.lit, floor)), F.col("i") + 1))
    wide = quartiles.groupBy("key").agg(
        *(F.max(F.when(F.col("i") == i, F.col("b"))).alias(f"m{i}") for i in range(d)),
        *(F.max(F.when(F.col("i") == i, spread)).alias(f"c{i}{i}") for i in range(d)),
    )
    return wide.select("key", *(f"m{i}" for i in range(d)), *((F.col(f"c{i}{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)))


def _squared(d: int) -> Column:
    z = _distance([F.col(f"f{i}") for i in range(d)], [F.col(f"m{i}") for i in range(d)], [[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(d)])
    return reduce(lambda a, b: a + b, (v * v for v in z))


def _sums(d: int) -> dict[str, Column]:
    """What a mean and a covariance are made of."""
    values = [F.col(f"f{i}") for i in range(d)]
    return {"n": F.lit(1)} | {f"s{i}": values[i] for i in range(d)} | {f"p{i}{j}": values[i] * values[j] for i in range(d) for j in range(i + 1)}


def _starts(rows: DataFrame, members: DataFrame, floor: Sequence[float]) -> DataFrame:
    """Three deterministic starts per pool: (start, key, centers, factors).

    Medians with quartile spreads; the mean and covariance of all rows; and the medians with the
    covariance of spatial signs, directions from the median that no outlier's distance bends.
    """
    d = len(floor)
    middle = checkpointed(_first(rows, members, floor))
    sums = _sums(d)
    by_group = rows.groupBy("group_key").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    whole = by_group.join(members, "group_key").groupBy("key").agg(*(F.sum(k).alias(k) for k in sums))
    whole = _estimates(whole, ["key"], floor, 1.0)
    near = rows.join(broadcast_if_small(checkpointed(middle.join(members, "key")), BROADCAST_GROUPS), "group_key")
    z = [(F.col(f"f{i}") - F.col(f"m{i}")) / F.col(f"c{i}{i}") for i in range(d)]
    length = F.greatest(reduce(lambda a, b: a + b, (v * v for v in z)), F.lit(1e-12))
    signs = near.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(z[i] * z[j] / length).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)))
    staged = signs.join(middle, "key")
    cov = [[F.col(f"p{i}{j}") / F.col("n") * d * F.col(f"c{i}{i}") * F.col(f"c{j}{j}") + (floor[i] ** 2 if i == j else 0.0) for j in range(i + 1)] for i in range(d)]
    shaped = staged.select("key", *(f"m{i}" for i in range(d)), *(cov[i][j].alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)))
    turned = _with_factor(shaped, ["key"], [[F.col(f"p{i}{j}") for j in range(i + 1)] for i in range(d)], d)
    return reduce(DataFrame.unionByName, (e.withColumn("start", F.lit(i)) for i, e in enumerate((middle, whole, turned))))


def robust_estimates(rows: DataFrame, plan: OutlierPlan) -> DataFrame:
    """Minimum-covariance-determinant centers and factors per ``group_key``.

    ``rows`` has ``lang_key``, ``group_key`` and ``f0``... Each concentration step measures all
    rows against the last estimate and re-estimates from the nearest ``half`` of each pool: a
    large group, or a language or all rows where a small group needs their estimate. Rows
    are summed by pool and by the step of their log distance, partially before the shuffle, so
    the nearest half is found from sums alone: whole steps are taken until it is reached. What is
    gathered is one row per pool and step, whatever a pool's size. A row counts in each of its pools.
    """
    d = len(plan.spread_floor)
    keys = checkpointed(estimate_keys(rows, plan))
    scale = plan.half / chi_square_cdf(chi_square_quantile(plan.half, d), d + 2)
    members = checkpointed(pools(keys))
    sums = _sums(d)
    size = reduce(lambda a, b: a + b, (F.log(F.col(f"c{i}{i}")) for i in range(d)))  # half the determinant's logarithm

    few = 3 * members.limit(BROADCAST_GROUPS).count() <= BROADCAST_GROUPS

    def concentrated(estimate: DataFrame) -> DataFrame:
        held = estimate.join(members, "key")
        near = rows.join(F.broadcast(held) if few else held, "group_key").withColumn("step", F.floor(F.log(_squared(d) + 1e-9) * 32).cast("long"))
        pooled = near.groupBy("key", "start", "step").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
        per = Window.partitionBy("key", "start")
        nearest = pooled.withColumn("__before", F.sum("n").over(per.orderBy("step")) - F.col("n")).withColumn("__all", F.sum("n").over(per)).where(F.col("__before") < F.col("__all") * plan.half)
        kept = nearest.groupBy("key", "start").agg(*(F.sum(k).alias(k) for k in sums))
        return checkpointed(_estimates(kept, ["key", "start"], plan.spread_floor, scale))

    estimate = _starts(rows, members, plan.spread_floor)
    for _ in range(plan.trial_steps):
        estimate = concentrated(estimate)
    best = Window.partitionBy("key").orderBy(F.round(size, 9), "start")
    estimate = checkpointed(estimate.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth"))
    for _ in range(plan.trial_steps, plan.steps):
        fresh = concentrated(estimate)
        moved = fresh.select("key", size.alias("now")).join(estimate.select("key", size.alias("before")), "key").agg(F.max(F.abs(F.col("now") - F.col("before")))).first()[0]
        estimate = fresh
        if moved is None or 2 * moved <= plan.settled:
            break
    held = estimate.drop("start").join(members, "key")
    return checkpointed(held.join(keys.select("group_key", "key"), ["group_key", "key"]).drop("key"))


def judge(docs: DataFrame, plan: OutlierPlan = OutlierPlan(), carried: Sequence[str] = ()) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``distance`` (squared) and ``kept``.

    Counts are those of ``text_statistics``; a document is kept if it passes the base rules and
    its transformed statistics lie within the robust distance of its language and source. Rows
    that fail the base rules take no part in the estimates.

    Null or empty text has no words and fails; null languages and sources form groups of their
    own; repeated rows are judged alike; an empty table gives no rows; other columns are ignored
    unless named in ``carried``. Groups with fewer than ``least_rows`` rows use their language's
    estimate, or that of all rows; with no estimate at all the base rules decide. Texts are read
    once; statistics are written to the shared folder and only those are read again.
    """
    lang = source_key(F.col("lang"))
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), lang.alias("lang_key"),
        F.concat(F.length(lang).cast("string"), F.lit(":"), lang, source_key(F.col("source"))).alias("group_key"),
        *(F.col(c).alias(f"__carried_{c}") for c in carried),
    )
    counted = text_statistics(named, F.col("text")).drop("text").withColumn("base_failed", base_failed())
    counted = written(counted.select("*", *(v.alias(f"f{i}") for i, v in enumerate(transformed()))), "quality")
    d = len(FEATURES)
    estimate = robust_estimates(counted.where(~F.col("base_failed")).select("lang_key", "group_key", *(f"f{i}" for i in range(d))), plan)
    measured = counted.join(broadcast_if_small(estimate, BROADCAST_GROUPS), "group_key", "left").withColumn("distance", _squared(d))
    within = F.coalesce(F.col("distance") <= chi_square_quantile(plan.keep, d), F.lit(True))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"), "distance",
        *(F.col(f"__carried_{c}").alias(c) for c in carried),
    )
