"""Operator 4: mixing sources to target weights along a time-varying curriculum. Native only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.prefix import running_total
from linkloom.storage import broadcast_if_small, written

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Plans of up to so many documents, two numbers each, are broadcast to carried columns.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class MixPlan:
    """What the mix is to hold.

    ``weights`` and ``schedules`` go to the sources in code-point order (null last), repeating.
    A schedule is a list of (time, weight) knots from time 0 to 1, linear between them; it says
    when in training a source is shown, its integral is scaled to the source's target.
    """

    weights: Sequence[int] = (5, 2, 1)
    schedules: Sequence[Sequence[tuple[float, float]]] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
    budget: float = 1.5
    most_repeats: int = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null key that sorts by code point with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """Targets by water-filling: (source_key, source_size) to the same plus ``rank``, ``target``.

    With sources ordered by cap over weight, all before the k-th being full leaves the level
    (total - their caps) / (weights from k on); the first level that the k-th source can take is
    the one at which resharing ends. One row per source is all that is windowed here.
    """
    weights = F.array(*(F.lit(float(w)) for w in plan.weights))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1).select(
        "*",
        F.element_at(weights, (F.col("rank") % len(plan.weights) + 1).cast("int")).alias("__w"),
        (F.col("source_size") * plan.most_repeats).cast("double").alias("__cap"),
        (F.sum("source_size").over(Window.partitionBy()).cast("double") * plan.budget).alias("__total"),
    )
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = ranked.withColumn(
        "__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    ).withColumn("__fits", F.col("__level") * F.col("__w") <= F.col("__cap"))
    everyone = Window.partitionBy()
    level = F.min_by(F.when(F.col("__fits"), F.col("__level")), F.when(F.col("__fits"), F.struct(F.col("__cap") / F.col("__w"), F.col("rank")))).over(everyone)
    return levelled.withColumn("__water", level).select(
        "source_key", "source_size", "rank",
        F.coalesce(F.least(F.col("__cap"), F.col("__water") * F.col("__w")), F.col("__cap")).alias("target"),
    )


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """A schedule's pieces, each with the integral before it and the whole integral."""
    parts, mass = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots must advance in time and have weights of at least 0")
        parts.append((t0, t1, w0, w1, mass))
        mass += (t1 - t0) * (w0 + w1) / 2
    if not mass:
        raise ValueError("a schedule needs some weight")
    return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((*p, mass), ("t0", "t1", "w0", "w1", "m0", "mass"), strict=True))) for p in parts))


def training_time(share: Column, rank: Column, plan: MixPlan) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its target."""
    all_segments = F.array(*map(_segments, plan.schedules))
    mine = F.element_at(all_segments, (rank % len(plan.schedules) + 1).cast("int"))
    begun = F.filter(mine, lambda s: (s.m0 <= share * s.mass) & (s.w0 + s.w1 > 0))
    seg = F.element_at(begun, -1)
    part = (share * seg.mass - seg.m0) / (seg.t1 - seg.t0)
    below = seg.w0 + F.sqrt(F.greatest(F.lit(0.0), seg.w0 * seg.w0 + F.lit(2.0) * (seg.w1 - seg.w0) * part))
    inside = F.when(below > 0, F.lit(2.0) * part / below).otherwise(F.lit(0.0))
    return seg.t0 + (seg.t1 - seg.t0) * F.least(F.lit(1.0), inside)


def mix_sources(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", carried: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """One row per document, range-sorted by training position if ``ordered``.

    Columns: ``doc_id``, ``size`` (words), ``source_size``, ``target`` (of its source), ``taken``
    (words the mix takes, repeats counted) and ``readings``: for each reading that takes words
    its ``time`` (training time in [0, 1] at which it begins) and ``words``. ``position`` and
    ``repeat_position`` are the times of the first and the second, null where there is none.

    A source's documents, in the order of a digest of their id, form a tape that may be read
    ``most_repeats`` times; the mix takes the tape's first ``target`` words, so a source meets
    its target to within a word and no document exceeds its repeats. A reading begins at the
    time when the source's cumulative demand, the integral of its schedule, reaches its place on
    the tape.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own;
    rows that repeat an id are documents of their own; an empty table gives no rows; other
    columns are ignored unless named in ``carried``. Texts are read once: sizes are written to
    the shared folder, and only narrow rows are shuffled, by source and digest bucket.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            source_key(F.col("source")).alias("source_key"),
            word_count(F.col("text")).alias("size"),
            F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("__bucket"),
            F.conv(F.substring(digest, 4, 12), 16, 10).cast("long").alias("__key"),
            F.monotonically_increasing_id().alias("__row"),
            *(F.col(c).alias(f"__carried_{c}") for c in carried),
        ),
        "mix",
    )
    sources = written(source_targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), plan), "mix-sources")
    narrow = sized.select("doc_id", "source_key", "size", "__bucket", "__key", "__row")
    placed = running_total(narrow, ["source_key"], "__bucket", ["__key", "doc_id", "size", "__row"], "size", "__start").select("__row", "doc_id", "source_key", "size", "__start")
    if carried:  # only a row's place on its tape meets its carried columns
        whole = sized.select("__row", "doc_id", "source_key", "size", *(f"__carried_{c}" for c in carried))
        placed = whole.join(broadcast_if_small(written(placed.select("__row", "__start"), "mix-plan"), BROADCAST_ROWS), "__row")
    placed = placed.join(broadcast_if_small(sources, BROADCAST_ROWS), "source_key")

    def reading(i: int) -> Column:
        left = F.floor("target") - (F.col("source_size") * i + F.col("__start"))
        return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")

    def time(i: int) -> Column:
        share = F.try_divide(F.col("source_size") * i + F.col("__start"), F.col("target"))
        return F.when(reading(i) > 0, training_time(share, F.col("rank"), plan))

    every = F.array(*(F.struct(time(i).alias("time"), reading(i).alias("words")) for i in range(plan.most_repeats)))
    mixed = placed.withColumn("readings", F.filter(every, lambda r: r["words"] > 0))
    taken = F.aggregate("readings", F.lit(0).cast("long"), lambda acc, r: acc + r["words"])
    mixed = mixed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "readings", F.get("readings", 0)["time"].alias("position"), F.get("readings", 1)["time"].alias("repeat_position"),
        *(F.col(f"__carried_{c}").alias(c) for c in carried),
    )
    return mixed if not ordered else mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
