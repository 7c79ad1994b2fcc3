"""Topology, measures and relaxation against loops over the triangles."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platefield.operators import delaunay as D
from platefield.operators import mesh as M
from platefield.operators import relax as X
from platefield.operators.asof import cut_by_counts, positioned


@pytest.fixture(scope="module")
def mesh(spark):
    xy = np.random.default_rng(11).random((45, 2))
    nodes = spark.createDataFrame(pd.DataFrame({"plate_id": 0, "node_id": np.arange(45), "u": xy[:, 0], "v": xy[:, 1]}))
    stitched, triangles = D.globe_mesh(nodes)
    return xy, stitched.cache(), triangles.cache()


def _sets(stitched, triangles):
    uv = {r.node_id: (r.u, r.v) for r in stitched.collect()}
    mirror = {r.node_id: r.mirror_id for r in stitched.collect() if r.mirror_id is not None}
    return uv, mirror, {r.tri_id: (r.a, r.b, r.c) for r in triangles.collect()}


@pytest.mark.parametrize("falsy", [False, True])
def test_neighbors(mesh, falsy):
    _, stitched, triangles = mesh
    uv, mirror, tris = _sets(stitched, triangles)
    shown = lambda n: (mirror.get(n) or n) if falsy else mirror.get(n, n)
    want = {
        (i, shown(n)) for i in uv for t in tris.values() if any(n == i or mirror.get(n) == i for n in t)
        for n in t if shown(n) != i
    }
    got = {(r.src, r.dst) for r in M.mesh_neighbors(triangles, falsy).collect()}
    assert got == want


def test_relaxation(mesh, spark):
    _, stitched, triangles = mesh
    uv, mirror, tris = _sets(stitched, triangles)
    own = [n for n in uv if n not in mirror]
    age = {n: (n * 37 % 23) / 23 for n in own}

    def point(n):
        u, v = uv[n]
        theta, phi = 2 * math.pi * u, math.pi * (v - 0.5)
        return np.array([-math.cos(phi) * math.sin(theta), math.sin(phi), -math.cos(phi) * math.cos(theta)])

    near = {i: {mirror.get(n, n) for t in tris.values() if i in [mirror.get(m, m) for m in t] for n in t} - {i} for i in own}
    d = {i: np.zeros(3) for i in own}
    for _ in range(3):
        d = {
            i: (d[i] + sum((point(i) - point(n)) * max(0, age[i] - age[n]) + d[n] for n in near[i])) / len(near[i])
            for i in own
        }
    nodes = stitched.where("mirror_id is null").withColumn("age", (F.col("node_id") * 37 % 23) / 23)
    alone = nodes.limit(1).select("plate_id", F.lit(999).cast("bigint").alias("node_id"), "mirror_id", "u", "v", "age")
    neighbors = M.mesh_neighbors(triangles).join(nodes.select("plate_id", F.col("node_id").alias("src")), ["plate_id", "src"])
    for every in (4, 2):
        out = X.relax_directions(neighbors, nodes.unionByName(alone), 3, every).collect()
        got = {r.node_id: (r.dx, r.dy, r.dz) for r in out}
        assert got.pop(999) == (None, None, None)
        assert set(got) == set(own)
        for i in own:
            assert got[i] == pytest.approx(tuple(d[i]), abs=1e-12)


def test_edges_and_hull_fit_euler(mesh):
    xy, stitched, _ = mesh
    nodes = stitched.where("mirror_id is null")
    triangles = D.delaunay_mesh(nodes).cache()
    hull = D.hull_nodes(triangles).count()
    n = len(xy)
    assert triangles.count() == 2 * n - 2 - hull
    assert M.mesh_edges(triangles, nodes).count() == 3 * n - 3 - hull
    assert M.mesh_adjacent_triangles(triangles).count() == 2 * (3 * n - 3 - 2 * hull)


def test_measures(mesh):
    _, stitched, triangles = mesh
    rows = M.triangle_measures(triangles, stitched, 0.5).collect()
    for r in rows:
        if r.area is not None:
            assert r.area == pytest.approx(r.angle_a + r.angle_b + r.angle_c - math.pi)
            assert r.target_size == pytest.approx(r.area * 0.5)


def test_index_buffer_parts(mesh):
    _, stitched, triangles = mesh
    _, _, tris = _sets(stitched, triangles)
    parts = M.mesh_index_buffer(triangles, part_size=10).orderBy("part").collect()
    flat = [i for p in parts for i in p.indices]
    assert flat == [i for t in sorted(tris) for i in reversed(tris[t])]


def test_corners_meet_in_one_join(spark):
    triangles = spark.createDataFrame([(0, 0, 1, 2, 3), (0, 1, 3, 2, 9), (1, 0, 2, 2, 1)], "plate_id bigint, tri_id bigint, a bigint, b bigint, c bigint")
    lookup = spark.createDataFrame([(p, n, n * 1.5, None if n == 2 else p + 0.5) for p in (0, 1) for n in (1, 2, 3)], "plate_id bigint, node_id bigint, u double, age double")
    got = sorted(tuple(r) for r in M.join_corners(triangles, lookup, ["u", "age"]).collect())
    # The triangle with a corner nobody knows is gone; a NULL value stays NULL.
    assert got == [(0, 0, 1, 2, 3, 1.5, 0.5, 3.0, None, 4.5, 0.5), (1, 0, 2, 2, 1, 3.0, None, 3.0, None, 1.5, 1.5)]


def test_measures_need_few_exchanges(spark):
    nodes = spark.createDataFrame([(0, 0, None, 0.1, 0.1)], "plate_id bigint, node_id bigint, mirror_id bigint, u double, v double")
    triangles = spark.createDataFrame([(0, 0, 0, 0, 0)], "plate_id bigint, tri_id bigint, a bigint, b bigint, c bigint")
    areas = M.triangle_measures(triangles, nodes).select("plate_id", "tri_id", "area")
    plan = areas._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("spokes,closed,part_rows", [(3000, True, 400), (3000, False, 400), (12, True, 1 << 18), (12, False, 1 << 18)])
def test_walks_around_a_hub(spark, spokes, closed, part_rows):
    """A wheel, whole or with a gap: the walk around its hub is in bounded parts and goes clockwise."""
    turn = 2 * math.pi * np.arange(spokes) / spokes
    nodes = [(0, 0, 0.0, 0.0)] + [(0, i + 1, math.cos(a), math.sin(a)) for i, a in enumerate(turn)]
    rims = [(i + 1, (i + 1) % spokes + 1) for i in range(spokes if closed else spokes - 1)]
    triangles = spark.createDataFrame([(0, t, 0, p, q) for t, (p, q) in enumerate(rims)], "plate_id int, tri_id long, a long, b long, c long")
    nodes = spark.createDataFrame(nodes, "plate_id int, node_id long, u double, v double")
    # Edge 3t + 2 comes from the second rim node of triangle t; one rim node (edge 1 ends at it) and a repeated start too.
    starts = spark.createDataFrame([(0, 3 * 5 + 2), (0, 3 * 5 + 2), (0, 1), (0, 10**9)], "plate_id int, start_edge long")
    got = {}
    for r in M.mesh_edges_around_point(triangles, nodes, starts, part_rows).collect():
        got.setdefault((r.start_edge, r.node_id), []).append((r.step, r.edge_id))
    got = {k: [e for _, e in sorted(v)] for k, v in got.items()}
    hub = [3 * t + 2 for t in range(5, -1, -1)] + ([3 * t + 2 for t in range(spokes - 1, 5, -1)] if closed else [])
    assert got[17, 0] == hub and len(got) == 2
    # Around rim node 2: from node 1 on the rim, then from the hub, where the outside begins.
    assert got[1, 2][0] == 1 and len(got[1, 2]) <= 2


def test_parts_of_a_hub_are_bounded(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("node"), (-F.col("id") / 7.0).alias("x"), F.col("id"))
    rows = rows.unionByName(spark.range(3).select(F.lit(1).alias("node"), F.lit(0.0).alias("x"), "id"))
    got = positioned(rows, ["node"], ["x", "id"], "k", 1000)
    assert got.where("node = 0 and k <> 19999 - id or node = 1 and k <> id").count() == 0 and got.count() == 20_003
    sizes = [r["count"] for r in cut_by_counts(rows, ["node"], ["x", "id"], 1000).groupBy("_part").count().collect()]
    assert max(sizes) < 3000
