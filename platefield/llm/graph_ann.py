"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one point that keeps its smallest ids. Points are dealt into shards of
bounded size by a hash. A shard's graph starts from random edges; twice over, greedy searches
from the medoid propose neighbours of each point, and robust pruning keeps a diverse
few: the nearest candidate p goes in, and candidates c with alpha * d(p, c) <= d(point, c)
go out, alpha above 1 in the second round, so long edges stay. Reverse edges are added and pruned the same way.

Each query searches every shard by a beam of ``beam`` points. Searches run for blocks of
queries at once: in a step, each query expands its nearest point that isn't expanded yet.
Hits are ranked by exact Euclidean distance in double precision over the given components.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components take
no part; vectors of different lengths never meet; ties go to the smaller id; rows with the
same vector and id count once; a NULL id takes no part; no vectors or no queries give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

SHARD = 4096
DEGREE = 32
BUILD_BEAM = 48
BEAM = 96
ALPHA = 1.2
#: Points or queries that search at once.
TOGETHER = 256


def distances(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances from queries[i] to vectors[ids[i, j]]."""
    gap = vectors[ids] - queries[:, None, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def beam_search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and squared distances, nearest first, one row per query; -1 where fewer were met.

    ``edges`` has a row of neighbours per point, filled up with -1.
    """
    n = len(queries)
    found = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf)
    expanded = np.ones((n, beam), bool)
    found[:, 0] = start
    near[:, 0] = distances(vectors, found[:, :1], queries)[:, 0]
    expanded[:, 0] = False
    seen = np.zeros((n, len(vectors)), bool)
    seen[:, start] = True
    rows = np.arange(n)
    active = rows
    while len(active):
        pick = np.argmax(~expanded[active], axis=1)
        expanded[active, pick] = True
        next_ids = edges[found[active, pick]]
        fresh = (next_ids >= 0) & ~seen[active[:, None], next_ids]
        seen[active[:, None], np.where(fresh, next_ids, start)] = True
        gap = np.where(fresh, distances(vectors, next_ids, queries[active]), np.inf)
        all_near = np.concatenate([near[active], gap], axis=1)
        keep = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(all_near, keep, 1)
        found[active] = np.take_along_axis(np.concatenate([found[active], np.where(fresh, next_ids, -1)], axis=1), keep, 1)
        done = np.concatenate([expanded[active], ~fresh], axis=1)
        expanded[active] = np.take_along_axis(done, keep, 1) | ~np.isfinite(near[active])
        active = active[~expanded[active].all(1)]
    return found, near


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point, nearest first; candidates of -1 are none."""
    own = candidates == points[:, None]
    ids = np.where(own, -1, candidates)
    # A candidate named twice counts once.
    order = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, order, 1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    gap = np.where(ordered >= 0, distances(vectors, ordered, vectors[points]), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    ids, gap = np.take_along_axis(ordered, order, 1), np.take_along_axis(gap, order, 1)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    open_ = np.isfinite(gap)
    for k in range(degree):
        left = open_.any(1)
        if not left.any():
            break
        pick = np.argmax(open_, axis=1)
        chosen = ids[rows, pick]
        out[left, k] = chosen[left]
        between = distances(vectors, ids, vectors[chosen])
        # Squared distances, hence alpha squared. The chosen one is at 0 from itself and goes too.
        open_ &= alpha * alpha * between > gap
        open_[rows, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges and entry point of one shard's graph."""
    n = len(vectors)
    degree = max(1, min(degree, n - 1))
    rng = np.random.default_rng(seed)
    middle = vectors - vectors.mean(0)
    start = int(np.argmin(np.einsum("ij,ij->i", middle, middle)))
    # No row of edges holds a point twice, here and below: a search takes each of a row's points as new.
    edges = np.sort(rng.integers(0, n, (n, degree)), axis=1)
    edges[:, 1:][edges[:, 1:] == edges[:, :-1]] = -1
    edges[edges == np.arange(n)[:, None]] = -1
    if n == 1:
        return edges, start
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, TOGETHER):
            points = order[lo : lo + TOGETHER]
            met, _ = beam_search(vectors, edges, start, vectors[points], beam)
            chosen = robust_prune(vectors, points, np.concatenate([met, edges[points]], axis=1), degree, a)
            edges[points] = chosen
            link_back(vectors, edges, points, chosen, a)
    return edges, start


def link_back(vectors: np.ndarray, edges: np.ndarray, points: np.ndarray, chosen: np.ndarray, alpha: float) -> None:
    """Add the reverse of new edges; a point with too many is pruned."""
    to, source = chosen.ravel(), np.repeat(points, chosen.shape[1])
    there = to >= 0
    to, source = to[there], source[there]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(target), count.max() if len(count) else 0), -1, np.int64)
    more[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = source
    degree = edges.shape[1]
    for lo in range(0, len(target), TOGETHER):
        t = target[lo : lo + TOGETHER]
        new = more[lo : lo + TOGETHER]
        there = (new[:, :, None] == edges[t][:, None, :]).any(2)
        wide = np.concatenate([edges[t], np.where(there, -1, new)], axis=1)
        room = (wide >= 0).sum(1) <= degree
        packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)[:, :degree]
        edges[t[room]] = packed[room]
        if (~room).any():
            edges[t[~room]] = robust_prune(vectors, t[~room], wide[~room], degree, alpha)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


INDEX = "shard long, dim int, start int, points int, vectors binary, edges binary, ids array<array<long>>"


def build_index(vectors: DataFrame, item: str, vector: str, keep: int, shard: int = SHARD) -> DataFrame:
    """A row per shard: its points, graph and the ``keep`` smallest ids of each point."""
    rows = vectors.select(F.col(item).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("key", F.xxhash64("v"))
    # Zeros of both signs are one number.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("v")).dropDuplicates(["key", "v", "id"])
    # The window keeps few rows per vector on the map side already, so a hot vector is small.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).filter(F.col("r") <= keep)
    points = cut_lineage(ranked.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    counts = {r.dim: r.n for r in points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    shards = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // shard))]), F.size("v")), F.lit(1)
    ) if counts else F.lit(1)
    dealt = points.withColumn("shard", F.xxhash64(F.size("v"), F.pmod(F.xxhash64("key", F.lit(1)), shards)))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        v = np.array(group["v"].tolist(), float)
        edges, start = build(v)
        return pd.DataFrame({
            "shard": [group["shard"].iloc[0]], "dim": [v.shape[1]], "start": [start], "points": [len(v)],
            "vectors": [v.tobytes()], "edges": [edges.astype(np.int32).tobytes()], "ids": [[list(map(int, i)) for i in group["ids"]]],
        })

    return dealt.groupBy("shard").applyInPandas(make, INDEX)


def search_block(rows: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    out = []
    for r in rows.itertuples(index=False):
        v = np.frombuffer(r.vectors, float).reshape(r.points, r.dim)
        edges = np.frombuffer(r.edges, np.int32).reshape(r.points, -1).astype(np.int64)
        q = np.array([list(x) for x in r.queries], float)
        found, near = beam_search(v, edges, r.start, q, min(max(beam, k + 1), r.points))
        for query, hits, gaps in zip(r.query_ids, found, near):
            # Equal distances at the end may belong to smaller ids, so whole points are taken.
            best = [(d, i) for h, d in zip(hits, np.sqrt(gaps)) if h >= 0 for i in r.ids[h] if i != query]
            out += [(query, i, float(d)) for d, i in sorted(best)[:k]]
    return pd.DataFrame(out, columns=["query_id", "id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, item: str, vector: str, k: int = 10, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest rows of ``vectors`` other than the query's own id."""
    # One more than k, as a query's own id may be among those of its vector.
    index = cut_lineage(build_index(vectors, item, vector, k + 1, shard))
    asked = queries.select(F.col(item).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("q"))).dropDuplicates(["query_id", "q"])
    # Queries meet each shard in blocks of bounded size.
    n = asked.count()
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // TOGETHER)))))
    blocks = blocks.groupBy("block", F.size("q").alias("dim")).agg(F.collect_list(F.struct("query_id", "q")).alias("x"))
    blocks = blocks.select("block", "dim", F.col("x.query_id").alias("query_ids"), F.col("x.q").alias("queries"))
    shards = index.select("shard", "dim").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    pairs = blocks.join(shards, "dim").select("block", "query_ids", "queries", F.explode("shards").alias("shard"))
    met = pairs.join(index, "shard").select("block", "shard", "query_ids", "queries", "dim", "start", "points", "vectors", "edges", "ids")
    parts = max(1, min(10_000, pairs.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield search_block(batch, k, beam)

    hits = met.repartition(parts, "shard", "block").mapInPandas(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )
