"""Operator 3: chat formatting of reply trees."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.arrays import running_starts
from linkloom.llm.mixing import source_key
from linkloom.llm.prefix import running_total
from linkloom.storage import written

# Fixed control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Turns of one path that are gathered together first.
CHUNK = 64
#: Turn numbers that are sorted together.
STRETCH = 1024

READ_BACK = "struct<n_turns: long, turns_sha256: string, loss_chars: long, loss_sha256: string>"


@dataclass(frozen=True)
class ChatPlan:
    """``branches`` of each tree are formatted, best first; roles in ``learned`` bear loss."""

    branches: int = 1
    learned: tuple[str, ...] = (ASSISTANT,)


# -- template -------------------------------------------------------------------------------


def escaped(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes before the bar, one more than stood there already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """Roles stand on one line, so line feeds are escaped too."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    import re

    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.rpartition(END)[0])))
    return turns


def read_back(formatted: Column, loss: Column) -> Column:
    """Counts and digests that come from the output alone."""

    @F.arrow_udf(READ_BACK)
    def read(texts: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for text, mask in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
            turns = parse(text)
            learned = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append({"n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest()})
        return pa.array(out, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))

    return read(formatted, loss)


# -- reply trees ----------------------------------------------------------------------------


def _raised(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Iterative self-joins that double: per level each node's ancestor 2**level above, and at last depth and score sum.

    A path of n nodes takes log2(n) joins, each on (tree, node), which is unique, so that no
    join is skewed by a large tree. Nodes that have met their root leave the joins, so a round
    costs what is left of the long paths.
    """
    state = written(links.select("tree", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat")
    levels, done = [], state.where(F.col("up").isNull())
    while True:
        left = state.where(F.col("up").isNotNull())
        if not left.limit(1).count():
            return levels, done
        levels.append(left.select("tree", "node", "up"))
        above = done.unionByName(left).select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("total").alias("__total"))
        state = written(
            left.join(above, ["tree", "up"], "left").select(
                "tree", "node", F.col("__up").alias("up"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total"),
            ),
            "chat",
        )
        done = done.unionByName(state.where(F.col("up").isNull()))


def chosen_paths(nodes: DataFrame, plan: ChatPlan = ChatPlan()) -> DataFrame:
    """Nodes of the chosen root-to-leaf paths: (tree, leaf, node, place, branch).

    ``nodes`` has ``tree``, ``node``, ``parent`` and ``score``; a parent that is missing, or not before
    its child, makes the child a root, so there are no cycles. Branches rank by mean score, ties
    to the smaller leaf. Null scores count as 0; rows without a tree or node are left out; of rows
    that repeat a node the greatest parent and score count; an empty table gives no rows.
    """
    own = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(F.max("parent").alias("parent"), F.max("score").alias("score"))
    own = own.select("tree", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    present = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__there"))
    links = own.join(present, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("__there"), F.col("parent")).alias("parent"), "score")
    levels, state = _raised(links)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct() if levels else None
    leaves = state.join(parents, ["tree", "node"], "left_anti") if levels else state
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), "node"))
    best = leaves.withColumn("branch", rank).where(F.col("branch") <= plan.branches)
    members = written(best.select("tree", F.col("node").alias("leaf"), "node", F.col("depth").alias("place"), "branch"), "chat")
    for level, steps in enumerate(levels):
        raised = members.join(steps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << level)).alias("place"), "branch")
        members = written(members.unionByName(raised), "chat")  # read twice by the next level
    return members


def format_trees(nodes: DataFrame, plan: ChatPlan = ChatPlan()) -> DataFrame:
    """One row per chosen path: ``tree``, ``branch``, ``formatted`` and ``loss`` (spans of code points under the loss mask).

    ``nodes`` has ``tree``, ``node``, ``parent``, ``score``, ``role`` and ``text`` and is read from storage.
    Null roles and texts are empty; rows that repeat a node are turns of their own at its place,
    ordered by what they say; an empty table gives no rows; other columns, whatever their names,
    are ignored. Turns are formatted where they are; each path is gathered by chunks of turns
    first, then by chunks, as one row that holds the conversation.
    """
    paths = chosen_paths(nodes, plan)
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = nodes.select("tree", "node", F.concat(head, body, F.lit(END + "\n")).alias("turn"), F.length(head).alias("skip"), F.length(body).alias("size"), F.col("role").isin(*plan.learned).alias("bears"))
    placed = paths.join(turns, ["tree", "node"]).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    chunks = placed.groupBy("tree", "branch", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "skip", "size", "bears"))).alias("turns"))
    whole = chunks.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("chunk", "turns"))).alias("chunks"))
    whole = whole.select("tree", "branch", F.flatten(F.transform("chunks", lambda c: c["turns"])).alias("turns"))
    starts = running_starts(F.transform("turns", lambda t: F.length(t["turn"]).cast("bigint")))
    whole = whole.withColumn("starts", starts)
    span = lambda t, i: F.struct((F.element_at("starts", i + 1) + t["skip"]).alias("start"), (F.element_at("starts", i + 1) + t["skip"] + t["size"]).alias("end"), t["bears"].alias("bears"))
    loss = F.transform(F.filter(F.transform("turns", span), lambda s: F.coalesce(s["bears"], F.lit(False))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return whole.select("tree", "branch", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it.

    Turns that tie are ordered by role and text, null turns first; repeated rows stay. Turns are
    numbered in stretches of ``STRETCH``, so that a long conversation is sorted by many tasks.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    keyed = conversations.select(
        source_key(F.col("conv_id")).alias("tree"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    dealt = keyed.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))).withColumn("one", F.lit(1).cast("long"))
    numbered = running_total(dealt, ["tree"], "stretch", order, "one", "before").withColumn("node", F.col("before") + 1)
    return numbered.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame, plan: ChatPlan = ChatPlan()) -> DataFrame:
    """One row per conversation: ``conv_id``, what is read back from the output, ``formatted_chars`` and ``formatted``.

    A null ``conv_id`` is a conversation of its own; null texts and roles are empty; an empty
    table gives no rows; other columns are ignored.
    """
    nodes = written(conversation_nodes(conversations), "chat")
    formatted = format_trees(nodes, plan).withColumn("__back", read_back(F.col("formatted"), F.col("loss")))
    conv = F.when(F.col("tree") != "1", F.substring("tree", 2, 30).cast("long"))
    return formatted.select(conv.alias("conv_id"), "__back.n_turns", "__back.turns_sha256", "__back.loss_chars", "__back.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "loss")
