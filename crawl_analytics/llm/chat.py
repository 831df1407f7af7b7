"""Chat formatting of reply trees. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """Control strings made harmless: every ``<``, backslashes, ``|`` gets one backslash more. Nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role ends at a line break, so line breaks, ``<`` and ``%`` in it are percent-encoded."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, node, parent, score) -> (tree, leaf, node, depth, path_score): every root-to-leaf path, one row per node on it.

    Two runs of self-joins, each as many as the depth has binary digits. Upwards, a node joins the node its jump ends
    at and takes over that one's jump, depth and score: jumps of 1, 2, 4, ... parents, kept as one table per
    length. Downwards, each leaf's path is cut at these jumps until the pieces are single nodes, so the rows
    made are the rows returned. path_score is the mean score of a path's nodes. A parent that is not in the tree
    counts as none; a node on a cycle is on no path from a root and is left out. (tree, node) must be unique.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.join(known, (nodes["tree"] == known["t"]) & (nodes["parent"] == known["p"]), "left")
    # up: the node where the jump ends, NULL beyond the root; steps and total: of the jump, or to the root if that is nearer
    jumps = linked.select("tree", "node", F.col("p").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("score").alias("total"))
    jumps = stored(jumps, "reply-jumps")
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    # only nodes whose jump has not reached the root go on; the others' steps and totals are final
    ended, open_ = [jumps.where("up is null")], jumps.where("up is not null")
    levels = [open_]
    for _ in range((largest - 1).bit_length()):  # no path is longer than the largest tree
        far = reduce(DataFrame.unionByName, [*ended, open_])
        far = far.select(F.col("tree").alias("t"), F.col("node").alias("u"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("total").alias("rest"))
        both = open_.join(far, (open_["tree"] == far["t"]) & (open_["up"] == far["u"]))
        steps, total = F.col("steps") + F.col("more"), F.col("total") + F.col("rest")
        longer = stored(both.select("tree", "node", F.col("far").alias("up"), steps.alias("steps"), total.alias("total")), "reply-jumps")
        ended.append(longer.where("up is null"))
        open_ = longer.where("up is not null")
        levels.append(open_)
    rooted = reduce(DataFrame.unionByName, ended)
    inner = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(inner, (rooted["tree"] == inner["t"]) & (rooted["node"] == inner["p"]), "left_anti")
    score = F.col("total") / (F.col("steps") + 1)
    # a piece: the ``long`` nodes from ``node`` upwards
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth"), score.alias("path_score"), (F.col("steps") + 1).alias("long"))
    for k in range(len(levels) - 1, -1, -1):
        half = 1 << k
        jump = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        cut = paths.join(jump, (paths["tree"] == jump["t"]) & (paths["node"] == jump["n"]), "left")
        near = F.struct(F.col("node").alias("node"), F.col("depth").alias("depth"), F.least(F.col("long"), F.lit(half)).alias("long"))
        rest = F.struct(F.col("up").alias("node"), (F.col("depth") - half).alias("depth"), (F.col("long") - half).alias("long"))
        pieces = F.when(F.col("long") > half, F.array(near, rest)).otherwise(F.array(near))
        paths = cut.select("tree", "leaf", "path_score", F.explode(pieces).alias("piece")).select("tree", "leaf", "path_score", "piece.*")
    return paths.select("tree", "leaf", "node", "depth", "path_score")


def best_paths(paths: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` best-scored paths of every tree, ties to the smallest leaf; adds ``branch``, 1 for the best."""
    leaves = paths.groupBy("tree", "leaf").agg(F.max("path_score").alias("path_score"))
    branch = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    chosen = leaves.withColumn("branch", branch).where(F.col("branch") <= most).drop("path_score")
    return paths.join(chosen, ["tree", "leaf"])


def formatted(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_spans`` as (begin, length) in characters of it.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped; the spans cover the escaped texts of assistant turns.
    A conversation is one training example, so it is one value. NULL roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(*by, *order, escaped_role(role).alias("role"), escaped(text).alias("text"), (role == LEARNED).alias("learned"))
    rows = rows.withColumn("turn", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")))
    end = F.sum(F.length("turn")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("begin", end - F.length("text") - F.lit(len(END) + 1))
    row = F.struct(*order, "turn", "learned", "begin", F.length("text").alias("length"))
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    learned = F.filter("turns", lambda x: x["learned"])
    spans = F.transform(learned, lambda x: F.struct(x["begin"].cast("int").alias("begin"), x["length"].alias("length")))
    return whole.select(*by, F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame, by: list[str]) -> DataFrame:
    """What a reader finds in ``formatted`` and under ``loss_spans``: counts and digests, unescaped."""
    blocks = F.filter(F.split("formatted", F.lit(r"<\|im_end\|>\n")), lambda b: b != "")
    body = lambda b: F.substring(b, len(START) + 1, 2_147_483_647)
    role = lambda b: unescaped_role(F.substring_index(body(b), "\n", 1))
    text = lambda b: unescaped(F.regexp_replace(body(b), r"^[^\n]*\n", ""))
    said = F.array_join(F.transform(blocks, lambda b: F.concat(role(b), F.lit("\n"), text(b), F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["begin"] + 1, s["length"]))), "")
    return conversations.select(
        *by,
        F.size(blocks).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        learned.alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        *by,
        "n_turns",
        "turns_sha256",
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def as_trees(conversations: DataFrame) -> DataFrame:
    """Turn lists as reply trees: every row answers the one before it, by turn; longer texts score higher.

    Rows of a conversation with the same turn follow one another by role and text, NULLs first. Adds tree, node, parent and score.
    """
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(ordered).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    score = F.length(F.coalesce("text", F.lit(""))).cast("double")
    return rows.select("conv_id", tree.alias("tree"), "node", parent.alias("parent"), score.alias("score"), "role", "text")


def chosen_branches(messages: DataFrame, most: int = 1) -> DataFrame:
    """Format the best ``most`` branches of every tree of (tree, node, parent, score, role, text).

    Returns tree, leaf, branch, formatted and loss_spans. Only ids and scores take part in the joins that
    find the paths; role and text join once, with the paths that were chosen.
    """
    paths = best_paths(stored(reply_paths(messages), "reply-paths"), most)
    said = messages.select("tree", "node", "role", "text")
    return formatted(paths.join(said, ["tree", "node"]), ["tree", "leaf", "branch"], ["depth"])


def conversations_formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from its format.

    Other columns are ignored; rows without a conv_id form one conversation of their own; an empty table gives an empty result.
    """
    trees = stored(as_trees(conversations), "reply-trees")
    found = read_back(chosen_branches(trees), ["tree"])
    conv = F.when(~F.col("tree")["none"], F.col("tree")["id"])
    return found.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
