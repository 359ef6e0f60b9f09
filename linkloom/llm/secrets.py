"""Operator 9: secret scans with multipart credential linking. Native DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import running_starts
from linkloom.storage import written

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
# Weak candidates, which alone say nothing: a long mixed token, and an address.
PART = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_.=-])"
ENDPOINT = r"(?i:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"

KINDS = ("assign", "access", "hex", "part", "endpoint")
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


@dataclass(frozen=True)
class LinkPlan:
    """``scope``: code points on either side of a span within which parts belong together."""

    scope: int = 256
    block: int = 256


def with_spans(docs: DataFrame, text: str, pattern: str, rank: int, out: str, block: int, least: int = 0) -> DataFrame:
    """Adds ``out``: leftmost non-overlapping matches as (start, rank, end) in code points, end exclusive.

    The text is split at the matches; what lies between them and what they hold, measured in
    turn, gives every position. ``least`` is what the pattern's first group must hold. Steps are
    columns of their own, since a lambda would evaluate them anew for each match.
    """
    none = F.array().cast(SPAN)
    hit = F.col(text).rlike(pattern)
    staged = docs.withColumn("__hits", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    staged = staged.withColumn("__gaps", F.when(F.col("__hits").isNotNull(), F.split(text, pattern, -1)))
    turns = F.zip_with(F.slice("__gaps", 1, F.size("__hits")), "__hits", lambda gap, hit: F.length(gap).cast("bigint") + F.length(hit))
    staged = staged.withColumn("__turns", turns)
    staged = staged.withColumn("__ends", F.when(F.col("__turns").isNotNull(), running_starts(F.col("__turns"), block)))
    made = F.transform(
        "__hits",
        lambda hit, i: F.struct(
            (F.element_at("__ends", i + 2) - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), F.element_at("__ends", i + 2).alias("end"),
            (F.length(F.regexp_extract(hit, pattern, 1)) if least else F.lit(0)).alias("held"),
        ),
    )
    strong = F.filter(made, lambda s: s["held"] >= least) if least else made
    slim = F.transform(strong, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return staged.withColumn(out, F.coalesce(slim, none)).drop("__hits", "__gaps", "__turns", "__ends")


def listed(found: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def _linked(scanned: DataFrame, plan: LinkPlan) -> DataFrame:
    """Weak candidates whose complementary parts lie within the scope, one row per ``__row``.

    An interval join: candidates and the base spans of a text, widened by the scope, are dealt to
    the stretches of text they touch, and a candidate meets only the spans of its own stretches,
    those that the gap to it lets in. A stretch holds a bounded number of spans, so hot texts are
    split by it. A long mixed token counts where an access identifier is near; an address where
    an assigned secret is, or both an identifier and another secret (hexadecimal or such a token).
    """
    both, width = scanned, plan.scope * 4

    def spans(array: str) -> DataFrame:
        return both.select("__row", F.explode(array).alias("s"))

    def dealt(rows: DataFrame, around: int) -> DataFrame:
        reach = rows.select("*", (F.col("s.start") - around).alias("low"), (F.col("s.end") + around).alias("high"))
        return reach.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))

    def near(rows: DataFrame, others: DataFrame) -> DataFrame:
        a, b = dealt(rows, 0).alias("a"), dealt(others, plan.scope).alias("b")
        met = a.join(b, (F.col("a.__row") == F.col("b.__row")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.col("a.high") >= F.col("b.low")) & (F.col("a.low") <= F.col("b.high")), "left_semi")
        return met.select("__row", "s").distinct()

    identified = near(spans("__weak"), spans("__access"))
    tokens = identified.where(F.col("s.rank") == 3)
    secrets = spans("__secret")
    addressed = near(spans("__weak").where(F.col("s.rank") == 4), secrets.where(F.col("s.rank") == 0))
    addresses = near(identified.where(F.col("s.rank") == 4), secrets.where(F.col("s.rank") == 2).unionByName(tokens)).unionByName(addressed).distinct()
    return tokens.unionByName(addresses).groupBy("__row").agg(F.collect_list("s").alias("__more"))


def scan(docs: DataFrame, plan: LinkPlan = LinkPlan(), carried: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``found``.

    ``found`` holds all spans as (start, rank, end) in order, ``rank`` indexing ``KINDS``; ``spans``
    lists them as text, and the digest is of the base kinds' list. Base spans are never dropped;
    linking adds ``part`` and ``endpoint`` spans that no base span overlaps.

    Null or empty text has no spans (the digest is that of the empty string); repeated rows give
    a row each; an empty table gives no rows; other columns are ignored unless named in
    ``carried``. Texts are read once; only spans are written and shuffled.
    """
    outer = [f"__carried_{c}" for c in carried]
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
        F.monotonically_increasing_id().alias("__row"), *(F.col(c).alias(o) for o, c in zip(outer, carried, strict=True)),
    )
    first = with_spans(named, "__text", ASSIGN, 0, "__assign", plan.block, LEAST_VALUE)
    first = with_spans(first, "__text", ACCESS, 1, "__access", plan.block)
    first = with_spans(first, "__text", HEX, 2, "__hex", plan.block)
    first = first.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    # Weak candidates count only beside an access identifier or an assigned secret, so other texts aren't searched for them.
    told, assigned = F.size("__access") > 0, F.size("__assign") > 0
    first = first.withColumn("__near", F.when(told, F.col("__text")).otherwise(F.lit(""))).withColumn("__wide", F.when(told | assigned, F.col("__text")).otherwise(F.lit("")))
    first = with_spans(first, "__near", PART, 3, "__parts", plan.block)
    first = with_spans(first, "__wide", ENDPOINT, 4, "__endpoints", plan.block)
    second = first.select(
        "doc_id", *outer, "__row", "__access", "__base", F.concat("__assign", "__hex").alias("__secret"), F.concat("__parts", "__endpoints").alias("__weak"),
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
    )
    apart = F.filter("__weak", lambda w: ~F.exists("__base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    scanned = written(second.withColumn("__weak", apart), "secrets")
    linkable = F.size("__weak") > 0
    joined = scanned.where(linkable).join(_linked(scanned.where(linkable), plan), "__row", "left")
    every = F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast(SPAN))))
    shown = [*outer, "doc_id", *(f"n_{k}" for k in KINDS[:3]), "__base"]
    both = joined.select(*shown, every.alias("found")).unionByName(scanned.where(~linkable).select(*shown, F.col("__base").alias("found")))
    return both.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found",
        *(F.col(o).alias(c) for o, c in zip(outer, carried, strict=True)),
    )


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, start, step)
    rest = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    return F.concat(F.array_join(done["out"], ""), rest)
