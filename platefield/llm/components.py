"""Connected components of an edge table by alternating stars.

Defined results: an edge of a node to itself, a repeated edge and one with a NULL end add nothing, so a node
without another edge isn't listed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _least(edges: DataFrame) -> DataFrame:
    # As a table of its own, its size is known and a hot node's edges can be split in the join.
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges(a, b)``; the root is the least node of its component.

    Each round ties larger neighbours to the least one (large star), then smaller ones (small
    star); edges turn into stars around the roots in a number of rounds that grows with
    the logarithm of the component's size. A node with many edges is summed on the map side.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = cut_lineage(pairs)
    before, mark = None, _fingerprint(now)
    while mark != before and mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = _least(both)
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut_lineage(large)
        m = _least(large)
        small = large.join(m, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        before, mark = mark, _fingerprint(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
