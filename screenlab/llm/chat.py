"""Chat formatting: reply trees become conversations with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_frequent

START, END, TAIL = "<|im_start|>", "<|im_end|>", "\n"


def escape(text: Column) -> Column:
    """No "<|" is left in the result; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Split at escaped backslashes, undo the rest in between, join with one backslash.
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables to ancestors 1, 2, 4, ... up, and (id, root, depth, score) of every node that reaches a root.

    ``nodes``: id, parent (null at a root), score. Each round joins the pointers with
    themselves, so a tree of depth d takes log2(d) self-joins. A node whose parent is absent
    is a root; its pointers, and those past it, lead nowhere.
    """
    at = cut(nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"), F.col("id").alias("root")))
    tables: list[DataFrame] = []
    most = max(1, at.count()).bit_length() + 1
    while len(tables) < most and not (pointing := at.where("up is not null")).isEmpty():
        tables.append(pointing.select("id", "up"))
        above = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("t2"), F.col("root").alias("r2"))
        moved = pointing.join(above, "up", "left").select(
            "id", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"), F.coalesce("r2", "root").alias("root")
        )
        at = cut(moved.union(at.where("up is null")))  # what has reached its root joins no more
    return tables, at.where("up is null").select("id", "root", (F.col("n") - 1).alias("depth"), (F.col("total") / F.col("n")).alias("score"))


def paths(nodes: DataFrame, best: int) -> DataFrame:
    """(leaf, branch, id, pos): the messages of the ``best`` branches of each root, from the root down."""
    tables, placed = jumps(nodes)
    leaves = placed.join(nodes.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    sizes = placed.groupBy("root").agg(F.count("*").alias("many"))
    ends = cut(leaves.groupBy("root").agg(F.count("*").alias("ends"), F.min("id").alias("leaf")).join(sizes, "root"))
    # A tree of a single branch is that branch: its nodes need no search.
    plain = ends.where("ends = 1").select("root", "leaf", "many")
    one = join_frequent(placed.select("root", "id", F.col("depth").alias("pos")), plain, ["root"], "many", placed.count())
    one = one.select("leaf", F.lit(1).alias("branch"), "id", "pos")
    forks = ends.where("ends > 1").select("root")
    if forks.isEmpty():
        return one
    order = Window.partitionBy("root").orderBy(F.desc("score"), "id")
    chosen = leaves.join(forks, "root", "left_semi").withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    steps = cut(chosen.select(F.col("id").alias("leaf"), "branch", "id", F.col("depth").alias("pos")))
    for k, up in enumerate(tables):
        moved = steps.where(F.col("pos") >= 1 << k).join(up, "id")
        steps = cut(steps.union(moved.select("leaf", "branch", F.col("up").alias("id"), (F.col("pos") - (1 << k)).alias("pos"))))
    return one.union(steps)


def format_trees(messages: DataFrame, best: int = 1, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The ``best`` branches of each reply tree, each formatted as one conversation.

    ``messages``: tree (any key), id, parent, role, text, score. Root-to-leaf paths are
    enumerated by iterated self-joins of the reply edges, doubling the reach each time;
    branches rank within their root by mean score, then by leaf id. Result: tree, leaf,
    branch (1 is best), n_turns, segments array<struct<text, loss>>; the conversation is
    the concatenation of its segments, and the loss mask covers those with ``loss``.

    Edges alone are joined; texts are shuffled to be made distinct and to meet in their
    conversation. A message that is its own parent or whose parent is absent is a root.
    Repeated ids count once (least parent, role, hash of the text). Messages whose chain of
    parents is a cycle have no root and form no path. Null text or role is empty, null score 0.
    Further columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    m = messages.where("id is not null").select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("hash"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = cut(m.groupBy("id").agg(F.min(F.struct("parent", "role", "hash", "tree", "score")).alias("m")).select("id", "m.*"))
    steps = paths(nodes.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"), "score"), best)
    steps = steps.join(nodes.select("id", "tree", "role", "hash"), "id")
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(body.alias("text"), F.col("role").isin(*train_roles).alias("loss")),
        F.struct(F.lit(END + TAIL).alias("text"), F.lit(False).alias("loss")),
    )
    turn = F.struct("pos", pieces.alias("pieces"))
    said = m.groupBy("id", "role", "hash").agg(F.min("text").alias("text"))
    rows = said.join(steps, ["id", "role", "hash"])
    out = rows.groupBy("leaf", "branch").agg(F.first("tree").alias("tree"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.select("tree", "leaf", "branch", "n_turns", F.flatten(F.transform("turns", lambda t: t["pieces"])).alias("segments"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation alone."""
    turns = F.filter(F.split(formatted, r"\Q" + END + TAIL + r"\E", -1), lambda t: t != "")
    line = lambda t: F.instr(t, "\n")  # noqa: E731  the first line end closes the role
    return F.transform(
        turns,
        lambda t: F.struct(unescape_role(F.substr(t, F.lit(len(START) + 1), line(t) - 1 - len(START))).alias("role"), unescape(F.substr(t, line(t) + 1)).alias("text")),
    )
