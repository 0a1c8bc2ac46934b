"""Conversations from reply trees.

Messages point at their parents. Iterated self-joins that double the reach of every pointer
give each message its root, depth and the summed score of its branch in log2(depth) rounds.
The best leaves of every tree are then walked back to the root by halving strides over the
stored pointers, so a path is listed in as many rows as it has messages, never as arrays that
grow on the way. Messages and stretches that are done leave the rounds. Each chosen path is formatted as one text in which control strings of the
messages are escaped; a reader gets turns and the loss mask back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# Marks of the chat template: fixed values of the format.
OPEN = "<|turn|>"
CLOSE = "<|end|>"
MARK = "<|"


def escaped(text: Column) -> Column:
    """Backslashes doubled and every ``<|`` broken by a backslash, so no mark occurs in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    """As a text, with line ends written as ``\\n``, since a line end closes the role."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """Inverse of :func:`escaped` and :func:`escaped_role`."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(parts, "\\")


def branch_scores(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth (root: 1) and summed score of each message, and the pointers of each round.

    ``messages``: tree, node, parent (null for a root), score. Pointer table ``k`` holds the
    ancestor 2**k steps up. A message whose parent isn't there counts as a root; messages on a
    cycle have no root and are left out.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")
    )
    state = stored(state, "replies")
    size = state.count()
    done, open_ = state.filter("up is null"), state.filter("up is not null")
    pointers = []
    # a pointer that is still open after log2(size) rounds lies on a cycle
    for _ in range(max(1, size).bit_length() + 1):
        if open_.isEmpty():
            break
        pointers.append(open_.select("tree", "node", "up"))
        far = done.unionByName(open_).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("f_up"), F.col("score").alias("f_score"), F.col("depth").alias("f_depth")
        )
        moved = stored(
            open_.join(far, ["tree", "up"]).select(
                "tree",
                "node",
                F.col("f_up").alias("up"),
                (F.col("score") + F.col("f_score")).alias("score"),
                (F.col("depth") + F.col("f_depth")).alias("depth"),
            ),
            "replies",
        )
        done, open_ = done.unionByName(moved.filter("up is null")), moved.filter("up is not null")
    return done.drop("up"), pointers


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: tree, rank, node, position (from 1).

    Branches rank by their mean score per message, then the longer one, then the smaller leaf.
    """
    scored, pointers = branch_scores(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "node")
    leaves = (
        scored.join(parents, ["tree", "node"], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= branches)
    )
    # rows cover stretches: ``node`` and the ``size`` - 1 messages above it
    stretches = leaves.select("tree", "rank", "node", F.col("depth").alias("position"), F.col("depth").alias("size"))
    for k in range(len(pointers) - 1, -1, -1):
        step = 1 << k
        stretches = stored(stretches, "paths")
        halves = F.array(
            F.struct(F.col("node"), F.col("position"), F.lit(step).cast("long").alias("size")),
            F.struct(
                F.col("up").alias("node"),
                (F.col("position") - step).alias("position"),
                (F.col("size") - step).alias("size"),
            ),
        )
        long = stretches.filter(F.col("size") > step).join(pointers[k], ["tree", "node"])
        cut = long.select("tree", "rank", F.explode(halves).alias("s")).select("tree", "rank", "s.*")
        stretches = stretches.filter(F.col("size") <= step).unionByName(cut)
    return stretches.drop("size")


def format_paths(messages: DataFrame, paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One conversation per path: tree, rank, formatted, loss_spans (start, end in characters).

    ``messages``: tree, node, role, text; nulls count as empty. The spans cover the escaped
    text of each turn whose role is ``learn`` and nothing else.
    """
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    pieces = turns.select(
        "tree",
        "rank",
        F.struct("position", head.alias("head"), body.alias("body"), F.col("role").eqNullSafe(F.lit(learn)).alias("learn")).alias("turn"),
    )
    whole = pieces.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE) + 1
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + size(t)).alias("at"),
            F.when(
                t["learn"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), ""
    )
    return whole.select("tree", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) parsed from a formatted conversation."""
    ends = F.split(formatted, r"<\|end\|>\n")
    whole = F.slice(ends, 1, F.size(ends) - 1)
    return F.transform(
        whole,
        lambda t: F.struct(
            unescaped(F.substring(F.substring_index(t, "\n", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescaped(t.substr(F.length(F.substring_index(t, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(formatted.substr(s["start"] + 1, s["end"] - s["start"]))), ""
    )


def chained(rows: DataFrame, tree: str, order: list[str], role: str, text: str) -> DataFrame:
    """Messages of plain conversations: every row answers the one before it.

    Ties in ``order`` go by role, then text, nulls first; a null ``tree`` is one conversation of its own.
    """
    place = Window.partitionBy(tree).orderBy(*order, role, text)
    return rows.withColumn("node", F.row_number().over(place).cast("long")).select(
        F.col(tree).alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(1.0).alias("score"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """Format the best ``branches`` paths of each reply tree: tree, rank, formatted, loss_spans.

    ``messages``: tree, node, parent, score, role, text. Defined cases: null roles and texts
    count as empty, a null score as 0; a message whose parent is missing starts a path;
    messages on a cycle, or with a null node, are left out; an empty table gives no rows.
    Node ids are unique within a tree; repeated ones (tree and node alike) keep the row that sorts first
    by parent, role and text. Other columns are not read. A null tree is an ordinary key.
    """
    null_tree = F.struct(F.col("tree").isNull().alias("none"), F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("key"))
    first = (
        messages.filter("node is not null")
        .withColumn("given", F.col("tree"))
        .withColumn("tree", null_tree)
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", "role", "text", "score", "given")).alias("m"))
        .select("tree", "node", "m.*")
    )
    kept = stored(first, "messages")
    done = format_paths(kept, best_paths(kept, branches), learn)
    kind = messages.schema["tree"].dataType
    return done.withColumn("tree", F.when(~F.col("tree.none"), F.col("tree.key")).cast(kind))
