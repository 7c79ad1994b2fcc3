"""Chat formatting of reply trees.

Messages point to their parents. Iterative self-joins double the reach of each message's
pointer, so a tree of depth n takes log2(n) rounds; on the way they sum the scores from
the root, which ranks the branches (leaves) of a tree. The pointers of all rounds then
enumerate the paths of the chosen leaves, also in log2(n) joins. Each chosen path is formatted
as one conversation.

Template: ``### role: text</turn>`` and a line feed per turn. Inside roles and texts the
characters backslash, ``#``, ``<`` and ``:`` are written as pairs that begin with a backslash, so no
text can hold a mark, and reading the pairs gives the text back, whatever it is. The loss
mask lists the places (code points, exclusive end) of assistant texts.

Defined results: NULL roles and texts are empty; a parent that isn't there makes a root;
messages on or below a cycle belong to no path; rows with the same tree and id are one message (the
least by parent, role and text); an empty table gives an empty result; other columns are
ignored. A path is one row of output, so one conversation must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
#: What a text may not hold and what stands for it. A backslash always begins one of these pairs, so they can be told apart.
SIGNS = {"\\": "\\-", "#": "\\=", "<": "\\(", ":": "\\;"}
KEY = ["tree", "node"]


def escape(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for plain, put in SIGNS.items():
        out = F.replace(out, F.lit(plain), F.lit(put))
    return out


def unescape(s: Column) -> Column:
    for plain, put in reversed(SIGNS.items()):
        s = F.replace(s, F.lit(put), F.lit(plain))
    return s


def chains(turns: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of a table of turns: each one answers the one before. Equal turns go by role and text."""
    order = Window.partitionBy("tree").orderBy(F.col("_turn"), "role", "text")
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = rows.withColumn("node", (F.row_number().over(order) - 1).cast("long"))
    parent = F.when(F.col("node") > 0, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tied(a: DataFrame, b: DataFrame, left: str, how: str = "inner") -> DataFrame:
    """Join on the tree (NULL is a tree of its own) and on ``left`` = b.to."""
    return a.join(b, a["tree"].eqNullSafe(b["_tree"]) & (a[left] == b["_node"]), how).drop("_tree", "_node")


def pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables tree, node, up of ancestors at distance 1, 2, 4..., and tree, node, depth, total of messages that have a root."""
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    known = links.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.lit(True).alias("_there"))
    now = _tied(links, known, "parent", "left").select(
        "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), "total", F.lit(1).cast("long").alias("depth")
    )
    now = cut_lineage(now)
    size = messages.count()
    steps, rooted, before = [], now.filter("up IS NULL"), None
    while True:
        # Only what hasn't reached its root takes part in a round; deep trees are few.
        active = now.filter("up IS NOT NULL")
        left = active.count()
        # What lies on or below a cycle never reaches a root: it is all that is left once the reach is past the number of rows.
        if not left or left == before and 2 ** len(steps) > size:
            return steps, rooted.drop("up")
        before = left
        steps.append(active.select("tree", "node", "up"))
        ahead = rooted.unionByName(active).select(
            F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth")
        )
        now = cut_lineage(
            _tied(active, ahead, "up").select(
                "tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
            )
        )
        rooted = rooted.unionByName(now.filter("up IS NULL"))


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, node, place: the messages of the best ``branches`` root-to-leaf paths (all, if None).

    The score of a branch is the mean score of its messages; ties go to the smaller leaf.
    """
    messages = cut_lineage(messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.parent", "m.score"))
    steps, rooted = pointers(messages)
    parents = messages.filter("parent IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("parent").alias("_node")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["_tree"]) & (rooted["node"] == parents["_node"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("score"), "depth")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        chosen = chosen.filter(F.col("rank") <= branches)
    chosen = cut_lineage(chosen)
    met = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(steps):
        ahead = step.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        further = _tied(met, ahead, "node").select("tree", "leaf", F.col("_up").alias("node"), (F.col("up") + 2**k).alias("up"))
        met = cut_lineage(met.unionByName(further))
    best = chosen.select(F.col("tree").alias("_tree"), F.col("leaf").alias("_node"), "rank", "score", "depth")
    return _tied(met, best, "leaf").select("tree", "leaf", "rank", "score", "node", (F.col("depth") - F.col("up")).alias("place"))


def format_paths(messages: DataFrame, chosen: DataFrame, trained: str = TRAINED) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, loss(array of start, end)."""
    texts = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text")).alias("m")).select(
        F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("m.role").alias("role"), F.col("m.text").alias("text")
    )
    turns = _tied(chosen, texts, "node")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(COLON))
    body = escape(F.col("text"))
    turn = F.struct("place", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("trained"))
    grouped = turns.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        loss = F.when(t["trained"], F.concat(acc["loss"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["loss"])
        return F.struct((end + len(CLOSE)).alias("at"), loss.alias("loss"))

    return grouped.select(
        "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["loss"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), ":", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(t, F.length(role) + len(OPEN) + len(COLON) + 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order, as they were."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))
