"""Reply trees to conversations, in DataFrame operations only.

Every message names its parent. Iterative self-joins walk up the trees: each round doubles the distance that the
jumps of the round before cover, so a thread of n messages takes log2(n) rounds, and gives every message its depth
and the sum of the scores on its way from the root. Leaves are ranked by that sum in their tree; for the chosen ones
the same jumps, longest first, list the messages of the path. A path becomes one text:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n    for each message

In roles and texts ``&`` and ``<`` are written as ``&amp;`` and ``&lt;`` (a line feed in a role as ``&nl;``), so no control
string can occur inside them and :func:`messages` gets back exactly what went in. ``loss_spans`` are the code-point ranges of
the texts that a model learns from.

One path is one row of output, so its messages meet in one task; trees and paths are spread over all tasks.

Edge cases: a null role or text is empty. A message whose parent is missing starts a path. Messages on a cycle, or below
one, have no root and are left out. Equal sums go to the longer path, then to the smaller leaf. Trees without a name (null)
are one tree. An empty table gives no rows. Ids must be unique in their tree; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def messages(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def message(part: Column) -> Column:
        body = F.split(F.replace(part, F.lit(START), F.lit("")), "\n", 2)
        return F.struct(_unescaped_role(body[0]).alias("role"), unescaped(body[1]).alias("text"))

    return F.transform(parts, message)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss spans, one after the other."""
    pieces = F.transform(loss_spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(pieces, "")


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, to) of jumps of 1, 2, 4, ... steps, and (tree, node, depth, total) of all rooted messages.

    Messages whose jump has reached the root take no part in later rounds.
    """
    known = nodes.select("tree", F.col("node").alias("to"), F.lit(True).alias("found"))
    step = nodes.select("tree", "node", F.col("parent").alias("to"), "score").join(known, ["tree", "to"], "left")
    step = stage(step.select("tree", "node", F.when(F.col("found"), F.col("to")).alias("to"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    rounds = math.ceil(math.log2(max(2, step.count()))) + 1
    rooted, active, tables = step.where("to IS NULL"), step.where("to IS NOT NULL"), []
    for _ in range(rounds):
        if active.isEmpty():
            break
        tables.append(active.select("tree", "node", "to"))
        state = rooted.union(active)
        above = state.select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("total").alias("sum"))
        step = active.join(above, ["tree", "to"]).select("tree", "node", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("sum")).alias("total"))
        step = stage(step)
        rooted, active = rooted.union(step.where("to IS NULL")), step.where("to IS NOT NULL")
    return tables, rooted.select("tree", "node", "depth", "total")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, path_score, depth, node) of the messages on the ``branches`` best paths of each tree; depth counts from 1 at the root."""
    tables, rooted = _jumps(nodes)
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    path = stage(chosen.select("tree", F.col("node").alias("leaf"), F.col("total").alias("path_score"), "node"))
    for table in reversed(tables):
        more = path.join(table, ["tree", "node"]).select("tree", "leaf", "path_score", F.col("to").alias("node"))
        path = stage(path.union(more))
    return path.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def format_conversations(
    turns: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None,
    branches: int = 1, loss_roles: tuple[str, ...] = LOSS_ROLES,
) -> DataFrame:
    """One row per chosen path: ``tree``, ``leaf``, ``path_score``, ``n_turns``, ``formatted``, ``loss_spans``."""
    name = F.col(tree)
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    nodes = stage(turns.select(
        F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("")).alias("tree"), name.alias("name"), F.col(node).alias("node"), F.col(parent).alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), points.alias("score"),
    ))
    path = best_paths(nodes.select("tree", "node", "parent", "score"), branches)
    said = path.join(nodes.select("tree", "node", "name", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    said = said.select("tree", "name", "leaf", "path_score", "depth", F.col("role").isin(*loss_roles).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    said = said.withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learned"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    paths = said.groupBy("tree", "leaf").agg(F.first("name").alias("name"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return paths.select(
        F.col("name").alias(tree), "leaf", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def threads(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations without replies to choose from as trees: each row answers the one before by ``turn`` (then role and text)."""
    order = Window.partitionBy(conv_id).orderBy(turn, role, text)
    numbered = turns.select(conv_id, turn, role, text).withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
