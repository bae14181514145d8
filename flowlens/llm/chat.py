"""Reply trees as chat conversations.

Messages name their parent. A root-to-leaf path is enumerated by iterative self-joins that double
their reach: round k adds to each leaf's path the ancestors 2**k above those it has, and composes
the jump table with itself, so a path of n messages takes about log2(n) rounds and no more rows
than it has messages. Branches are ranked by the mean score of their messages, and each chosen
path is written as one conversation. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

START = "<|im_start|>"
STOP = "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without "<|": every "<", backslashes, "|" gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role in one line: its backslashes are doubled and its line ends written as backslash, n."""
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(plain, F.lit("<|"), F.lit("<\\p"))


def unescaped_role(role: Column) -> Column:
    """Undoes ``escaped_role``: pairs of a backslash and a sign are read from left to right."""
    signs = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1))
    return F.array_join(F.transform(signs, lambda x: F.when(x == "\\n", "\n").when(x == "\\p", "|").when(x == "\\\\", "\\").otherwise(x)), "")


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): the nodes of every leaf's path; up: steps above the leaf.

    ``nodes`` is a stored table (conv_id, id, parent_id) with unique ids per conversation. A
    parent that is not there makes its child a root. A cycle of parents raises ValueError.
    """
    def on(left: DataFrame, key: str, right: DataFrame, own: str) -> Column:
        return left["conv_id"].eqNullSafe(right["c"]) & (left[key] == right[own])

    known = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("upper"))
    jump = staged(nodes.where("parent_id is not null").join(known, on(nodes, "parent_id", known, "upper")).select("conv_id", "id", "upper"), "jump")
    parents = jump.select(F.col("conv_id").alias("c"), F.col("upper").alias("p")).distinct()
    leaves = nodes.join(parents, on(nodes, "id", parents, "p"), "left_anti")
    found = staged(leaves.select("conv_id", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("up")), "paths")
    left, reach = jump.count(), 1
    limit = 4 * (left + 1)
    while left:
        if reach > limit:
            raise ValueError("the parents of some messages form a cycle")
        step = jump.select(F.col("conv_id").alias("c"), F.col("id").alias("below"), "upper")
        more = found.join(step, on(found, "node", step, "below")).select("conv_id", "leaf", F.col("upper").alias("node"), (F.col("up") + reach).alias("up"))
        found = staged(found.unionByName(more), "paths")
        second = step.withColumnRenamed("upper", "top")
        jump = staged(jump.join(second, on(jump, "upper", second, "below")).select("conv_id", "id", F.col("top").alias("upper")), "jump")
        left, reach = jump.count(), 2 * reach
    return found


def chosen_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``paths`` of the ``branches`` leaves of each conversation whose messages score best on average.

    Null scores count as zero; ties go to the smaller leaf id. None: all branches.
    """
    every = staged(paths(nodes.select("conv_id", "id", "parent_id")), "paths")
    if branches is None:
        return every
    own = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = every.join(own, every["conv_id"].eqNullSafe(own["c"]) & (every["node"] == own["n"])).groupBy("conv_id", "leaf").agg(F.avg("score").alias("score"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))).where(F.col("place") <= branches)
    best = best.select(F.col("conv_id").alias("c"), F.col("leaf").alias("l"))
    return every.join(best, every["conv_id"].eqNullSafe(best["c"]) & (every["leaf"] == best["l"]), "left_semi")


def conversations_of(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen branch: conv_id, leaf, formatted, loss_spans.

    ``messages``: conv_id, id (long), parent_id, role, text, score. A turn is written as the start
    mark, the role, a line end, the text, the stop mark and a line end. ``loss_spans`` are the byte
    ranges (start, length) in UTF-8 of the assistant's texts. Null roles and texts are empty. Of
    rows that repeat an id in a conversation one counts, the least by parent, role and text; rows
    without an id are left out. Other columns are not read.
    """
    own = F.struct("parent_id", "role", "text", "score")
    unique = messages.where("id is not null").groupBy("conv_id", "id").agg(F.min(own).alias("m"))
    unique = staged(unique.select("conv_id", F.col("id").cast("long").alias("id"), F.col("m.parent_id").cast("long").alias("parent_id"), "m.role", "m.text",
                                  F.col("m.score").cast("double").alias("score")), "messages")
    chosen = chosen_paths(unique.select("conv_id", "id", "parent_id", "score"), branches)
    said = unique.select(F.col("conv_id").alias("c"), "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(said, chosen["conv_id"].eqNullSafe(said["c"]) & (chosen["node"] == said["id"])).select(
        "conv_id", "leaf", "up", (F.col("role") == LOSS_ROLE).alias("loss"),
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    in_order = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up"))
    tail = f"{STOP}\n"
    turn = F.concat("head", "body", F.lit(tail))
    turns = turns.select("conv_id", "leaf", "up", "loss", turn.alias("turn"), F.octet_length("body").cast("long").alias("long"),
                         F.octet_length(turn).cast("long").alias("size"))
    turns = turns.withColumn("start", F.sum("size").over(in_order) - F.col("long") - len(tail))
    item = F.struct((-F.col("up")).alias("at"), "turn", "loss", "start", F.col("long").alias("length"))
    whole = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return whole.select("conv_id", "leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform(
        F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    marked = F.split(formatted, r"<\|im_start\|>")
    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - (len(STOP) + 2))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))
    return F.transform(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, put together."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "")


def as_chains(turns: DataFrame) -> DataFrame:
    """The rows of a table of turns as messages: each turn answers the one before it.

    Turns are in order of ``turn`` (null first), and rows that repeat a turn in order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(order).cast("long").alias("id"), "role", "text")
    return numbered.withColumn("parent_id", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user's and an assistant's turn that both hold the template's own marks."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
                                 F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
