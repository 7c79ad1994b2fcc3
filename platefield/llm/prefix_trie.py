"""A trie of conversations by their opening turns, as balanced parentheses in shards.

A node stands for the first d turns of some conversation; every conversation that starts
so is its member. Savings of a node are what its last text costs once more for each further
member; a subtree's savings and its leaves are sums over the nodes below.

1. Turns get their place in the conversation. The turns' position-tagged digests are summed along it
   (96 bits), so the running sum names the node without a walk from turn to turn.
2. Nodes are grouped sums over all conversations, combined before the shuffle.
3. Of equal conversations one stands for all. Subtrees with at most ``unit`` nodes are dealt to
   shards as wholes, each with its spine: the larger nodes above it.
4. A shard writes its nodes as balanced parentheses in depth-first order. Blocks of the
   excess (opened less closed) keep their minimum in a range min-max tree, with which ``find_close`` finds where a
   subtree ends; ranks of leaf pairs and cumulative savings up to there are the sums.
5. Spines that shards share are merged by adding up; a node counts in one of its shards.

Depth is cut into bands of ``band`` turns, from the deepest up, and a band hands the sums of its tops to
the one above it, so neither a deep nor a wide conversation is the work of one task.

Defined results: rows without a conversation id belong to none and are left out; a NULL role
or text is empty; a NULL turn comes first, equal turns go by their digest; texts are taken whole; repeated rows
are turns of their own; without conversations there is no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import running_start

#: Nodes of a shard, about, and turns of a band.
SHARD, BAND = 1 << 16, 4096
#: Turn values whose rows are numbered in one window, and conversation ids of one piece of an ends list, as powers of two.
TURN_BITS, ID_BITS = 12, 12
#: Width of a turn's place.
PLACE_BITS = 36
#: Copies of a node that many paths meet.
SALTS = 32
#: Parentheses of a block of the range min-max tree.
BLOCK = 256

SIG = "decimal(38,0)"


# --- turns and paths


def digest(role: Column, text: Column) -> Column:
    """Names a turn; the length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def numbered_turns(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, name, chars) of each turn, without its text.

    Rows are numbered within 2^TURN_BITS turn values; only chunk counts are summed per conversation.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = messages.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), digest(col(role), col(text)).alias("name"),
        F.coalesce(F.length(col(text)), F.lit(0)).cast("long").alias("chars"),
    ).withColumn("_chunk", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62))))
    sums = rows.groupBy("conv_id", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("conv_id", "_chunk").orderBy(F.col("turn").asc_nulls_first(), "name")
    return rows.withColumn("_at", F.row_number().over(own) - 1).join(starts, ["conv_id", "_chunk"]).select(
        "conv_id", (F.col("_before") + F.col("_at")).alias("pos"), "name", "chars"
    )


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each conversation's nodes from the root on: conv_id, d, sig, parent, chars, total.

    ``turns(conv_id, pos, name, chars, total)``; ``lengths(conv_id, total)`` has all conversations, also turnless ones.
    """
    tag = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("name")))
    part = lambda i: F.conv(F.substring(tag, i, 12), 16, 10).cast(SIG)
    value = (part(1) * F.lit(1 << 48).cast("decimal(15,0)") + part(13)).cast("decimal(29,0)")
    walked = running_start(turns.withColumn("_value", value), ["conv_id"], "pos", "_value", PLACE_BITS, "_sum")
    own = walked.select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("d"), (F.col("_sum") + F.col("_value")).cast(SIG).cast("string").alias("sig"),
        F.col("_sum").cast(SIG).cast("string").alias("parent"), "chars", "total",
    )
    roots = lengths.select(
        "conv_id", F.lit(0).cast("long").alias("d"), F.lit("0").alias("sig"), F.lit(None).cast("string").alias("parent"),
        F.lit(0).cast("long").alias("chars"), F.col("total").cast("long").alias("total"),
    )
    return roots.unionByName(own)


# --- balanced parentheses


class Parentheses:
    """A tree in depth-first order; ``open_`` holds the place of each node's opening bracket."""

    def __init__(self, depths: np.ndarray):
        """``depths`` of the nodes in depth-first order, from one root of depth 0."""
        n = len(depths)
        # Before node i opens, i others have opened and all but its ancestors have closed.
        self.open_ = 2 * np.arange(n) - depths
        self.bits = np.full(2 * n, -1, dtype=np.int64)
        self.bits[self.open_] = 1
        self.excess = np.cumsum(self.bits)
        blocks = -(-2 * n // BLOCK)
        self.padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.padded[: 2 * n] = self.excess
        width = 1 << max(0, int(blocks - 1).bit_length())
        # Minimum of each block and of pairs below; leaf i is at width + i.
        self.low = np.full(2 * width, np.iinfo(np.int64).max)
        self.low[width : width + blocks] = self.padded.reshape(blocks, BLOCK).min(axis=1)
        self.width = width
        level = width
        while level > 1:
            self.low[level // 2 : level] = self.low[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2

    def _within(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """First place from ``at`` to the end of its block with an excess below ``limit``, else -1."""
        found = np.full(len(at), -1)
        todo = np.arange(len(at))
        end = (at // BLOCK + 1) * BLOCK
        for i in range(BLOCK):
            todo = todo[at[todo] + i < end[todo]]
            if not len(todo):
                break
            hit = self.padded[at[todo] + i] < limit[todo]
            found[todo[hit]] = at[todo[hit]] + i
            todo = todo[~hit]
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Place of the bracket that closes each one opened at ``at``."""
        limit = self.excess[at]
        found = self._within(at + 1 - ((at + 1) % BLOCK == 0), limit)
        todo = np.flatnonzero(found < 0)
        # Up to the first right neighbour whose minimum is low enough, then down to its first such block.
        node = at[todo] // BLOCK + self.width
        want = limit[todo]
        climbing = np.ones(len(todo), dtype=bool)
        while climbing.any():
            right = (node & 1) == 0
            hit = climbing & right & (self.low[np.minimum(node + 1, len(self.low) - 1)] < want)
            node = np.where(hit, node + 1, np.where(climbing, node >> 1, node))
            climbing &= ~hit
        while (inner := node < self.width).any():
            left = 2 * node
            down = np.where(self.low[np.minimum(left, len(self.low) - 1)] < want, left, left + 1)
            node = np.where(inner, down, node)
        found[todo] = self._within((node - self.width) * BLOCK, want)
        return found

    def subtree_sums(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sum of ``values``, one per node in depth-first order, over each subtree with its top."""
        close = self.find_close(self.open_)
        # Opened brackets up to a place count the nodes in depth-first order.
        opened = np.cumsum(self.bits > 0)
        first, end = opened[self.open_] - 1, opened[close]
        return [(total := np.append(0, np.cumsum(v)))[end] - total[first] for v in values]


def depth_first(parent: np.ndarray) -> np.ndarray:
    """Nodes in depth-first order; ``parent`` precedes its children (root: -1) and the nodes are sorted by depth."""
    n = len(parent)
    size = np.ones(n, dtype=np.int64)
    # Sizes bottom up, then each child starts behind its parent and its elder siblings.
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    start = np.zeros(n, dtype=np.int64)
    used = np.ones(n, dtype=np.int64)
    for i in range(1, n):
        p = parent[i]
        start[i] = start[p] + used[p]
        used[p] += size[i]
    order = np.empty(n, dtype=np.int64)
    order[start] = np.arange(n)
    return order


#: A shard's rows: leaf and own savings count in the subtree, children below it are handed up by a lower band.
ROWS = "shard long, d long, sig string, parent string, conv_id long, owned boolean, leaves long, own long, children long"
SUMS = "d long, sig string, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def _shard_sums(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["d", "sig"], kind="stable").reset_index(drop=True)
    number = pd.Series(np.arange(1, len(rows) + 1), index=pd.MultiIndex.from_frame(rows[["d", "sig"]]))
    # A root above all tops of the band; tops have no parent here.
    top = rows["d"].to_numpy() == rows["d"].min()
    keys = pd.MultiIndex.from_arrays([rows["d"] - 1, rows["parent"].fillna("")])
    parent = np.where(top, 0, number.reindex(keys).fillna(0).to_numpy().astype(np.int64))
    parent = np.append(-1, parent)
    order = depth_first(parent)
    depth = np.append(0, rows["d"].to_numpy() - rows["d"].min() + 1)
    value = lambda c: np.append(0, rows[c].to_numpy())[order]
    leaves, saved = Parentheses(depth[order]).subtree_sums(value("leaves"), value("own"))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    children = np.append(0, rows["children"].to_numpy())
    np.add.at(children, parent[1:], rows["owned"].to_numpy().astype(np.int64))
    convs = np.append(0, rows["conv_id"].to_numpy())
    return pd.DataFrame({
        "d": rows["d"], "sig": rows["sig"],
        "parent_conv_id": pd.Series(convs[parent[1:]]).astype("Int64").mask(top),
        "n_children": children[1:], "n_leaves": leaves[place[1:]], "saved_tokens": saved[place[1:]],
    })


# --- sums over the trie


def _band_sums(walks: DataFrame, nodes: DataFrame, carried: DataFrame | None, lo: int, hi: int, shard: int, shuffles: int) -> DataFrame:
    """Sums of all nodes of depth lo..hi over what lies below them; tops count what is below only."""
    inside = walks.filter((F.col("d") >= lo) & (F.col("d") <= hi)).withColumn("_last", F.least("total", F.lit(hi)))
    if lo:
        inside = inside.filter(F.col("_last") > lo)
    # Of conversations with one end in the band, that of the least id stands for all.
    ends = inside.filter("d = _last").groupBy("sig").agg(F.min("conv_id").alias("conv_id")).select("conv_id")
    steps = cut_lineage(inside.join(ends, "conv_id", "left_semi"))
    unit = max(1, shard // 4)
    heavy = steps.groupBy("d", "sig").agg(F.sum(F.col("_last") - F.col("d") + 1).alias("_weight")).filter(
        (F.col("_weight") > unit) | (F.col("d") == lo)
    ).select("d", "sig", F.lit(True).alias("_heavy"))
    # A node near the root lies on many paths, so each of these meets one of several copies of it.
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    heavy = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = steps.withColumn("_salt", salt).join(heavy, ["d", "sig", "_salt"], "left")
    # The unit of a conversation is its first light node; if it ends above, its last node.
    units = met.groupBy("conv_id").agg(
        F.coalesce(F.min_by("sig", F.when(F.col("_heavy").isNull(), F.col("d"))), F.max_by("sig", "d")).alias("_unit")
    ).select("conv_id", F.pmod(F.xxhash64("_unit"), F.lit(shuffles)).alias("shard"))
    dealt = steps.join(units, "conv_id").groupBy("shard", "d", "sig").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("_first")
    )
    found = dealt.join(nodes, ["d", "sig"])
    owned = (F.col("_first") == F.col("conv_id")) & (F.col("d") > lo)
    mine = lambda c: F.when(owned, c).otherwise(F.lit(0)).cast("long")
    own = (F.col("n_convs") - 1) * F.col("chars")
    leaf = F.col("childless").cast("long")
    if carried is None:
        rows = found.select(
            "shard", "d", "sig", "parent", "conv_id", owned.alias("owned"), mine(leaf).alias("leaves"), mine(own).alias("own"),
            F.lit(0).cast("long").alias("children"),
        )
    else:
        below = carried.select("d", "sig", F.col("n_children").alias("_c"), F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        rows = found.join(below, ["d", "sig"], "left").select(
            "shard", "d", "sig", "parent", "conv_id", owned.alias("owned"), mine(leaf + zero("_l")).alias("leaves"),
            mine(own + zero("_s")).alias("own"), mine(zero("_c")).alias("children"),
        )
    sums = rows.groupBy("shard").applyInPandas(_shard_sums, SUMS)
    return cut_lineage(sums.groupBy("d", "sig").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    ))


def _ends(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's list, piece by piece; a partition has its pieces in order."""
    key, digest_ = None, None
    for rows in pieces:
        done = []
        for d, sig, ids in zip(rows["d"], rows["sig"], rows["ids"]):
            if (d, sig) != key:
                if key is not None:
                    done.append((*key, digest_.hexdigest()))
                key, digest_ = (d, sig), hashlib.sha256(ids.encode())
            else:
                digest_.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["d", "sig", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest_.hexdigest())], columns=["d", "sig", "ends_sha256"])


def ends_digests(walks: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Lists are made in pieces of 2^ID_BITS ids; only the digest itself, which no hash can be cut
    at, reads the pieces of one node one after the other.
    """
    ended = walks.filter("d = total").select("d", "sig", "conv_id", F.shiftright("conv_id", ID_BITS).alias("_piece"))
    pieces = ended.groupBy("d", "sig", "_piece").agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )
    return pieces.repartition("d", "sig").sortWithinPartitions("d", "sig", "_piece").select("d", "sig", "ids").mapInPandas(
        _ends, "d long, sig string, ends_sha256 string"
    )


def trie(walks: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """All nodes of the trie; ``walks`` as :func:`paths` gives them, written out before.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    nodes = cut_lineage(walks.groupBy("d", "sig").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        (F.max(F.col("total") - F.col("d")) == 0).alias("childless"),
    ))
    # Two numbers, for bands and shards.
    deepest, n = nodes.agg(F.max("d"), F.count(F.lit(1))).first()
    results, carried = [], None
    for lo in range((max(deepest or 0, 1) - 1) // band * band, -1, -band):
        sums = _band_sums(walks, nodes, carried, lo, lo + band, shard, -(-n // shard) or 1)
        results.append(sums.filter(F.col("d") > lo) if lo else sums)
        carried = sums.filter(F.col("d") == lo)
    sums = results[0]
    for more in results[1:]:
        sums = sums.unionByName(more)
    none = hashlib.sha256(b"").hexdigest()
    leaf = F.col("childless").cast("long")
    joined = nodes.join(sums, ["d", "sig"], "left").join(ends_digests(walks), ["d", "sig"], "left")
    return joined.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        # The root alone has no owner.
        F.when(F.col("d") == 0, F.greatest("n_leaves", leaf)).otherwise(F.col("n_leaves")).alias("n_leaves"),
        "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
