"""The tiled triangulation against brute force and against one single tile."""

import numpy as np
import pandas as pd
import pytest

from platefield.functions.triangulate import in_circle, orient, triangulate
from platefield.operators.delaunay import delaunay, delaunay_mesh, globe_mesh, hull_nodes


def _frame(spark, plates):
    parts = []
    for plate, xy in plates.items():
        parts.append(pd.DataFrame({"plate_id": plate, "node_id": np.arange(len(xy)), "u": xy[:, 0], "v": xy[:, 1]}))
    return spark.createDataFrame(pd.concat(parts))


def _canonical(xy):
    ids = np.arange(len(xy))
    return {tuple(t) for t in triangulate(ids, xy[:, 0], xy[:, 1])}


def _by_plate(df):
    out = {}
    for r in df.select("plate_id", "a", "b", "c").collect():
        out.setdefault(r.plate_id, []).append((r.a, r.b, r.c))
    return out


@pytest.mark.parametrize("n", [3, 4, 12, 60])
def test_empty_circles(n):
    xy = np.random.default_rng(n).random((n, 2))
    points = [(x, y, i) for i, (x, y) in enumerate(xy.tolist())]
    tris = _canonical(xy)
    for a, b, c in tris:
        assert orient(points[a], points[b], points[c]) > 0
        assert not any(in_circle(points[a], points[b], points[c], points[d]) for d in range(n) if d not in (a, b, c))
    assert tris


def test_lattice_has_no_holes():
    grid = np.array([(x * 0.1, y * 0.1) for x in range(7) for y in range(5)])
    area = 0.0
    for a, b, c in _canonical(grid):
        p, q, r = grid[a], grid[b], grid[c]
        area += 0.5 * ((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    assert area == pytest.approx(0.6 * 0.4)


def test_collinear_has_no_triangles():
    line = np.column_stack([np.arange(6.0), 2 * np.arange(6.0)])
    assert _canonical(line) == set()


def test_tiles_agree_with_one_tile(spark):
    rng = np.random.default_rng(5)
    clustered = np.vstack([rng.normal(0.3, 0.001, (400, 2)), rng.random((300, 2)), rng.normal(0.8, 0.02, (200, 2))])
    lattice = np.array([(x / 24, y / 24) for x in range(24) for y in range(24)])
    circle = np.column_stack([np.cos(np.arange(150)), np.sin(np.arange(150))])
    line = np.column_stack([np.arange(90.0), np.arange(90.0) * 3])
    plates = {1: rng.random((1500, 2)), 2: clustered, 3: rng.random((20, 2)), 4: lattice, 5: circle, 6: line}
    got = _by_plate(delaunay(_frame(spark, plates), tile_points=40))
    for plate, xy in plates.items():
        mine = got.get(plate, [])
        assert len(mine) == len(set(mine))
        assert set(mine) == _canonical(xy), plate


def test_copies_count_once(spark):
    xy = np.random.default_rng(8).random((15, 2))
    doubled = np.vstack([xy, xy, xy])
    got = _by_plate(delaunay(_frame(spark, {0: doubled})))
    assert set(got[0]) == _canonical(xy)


def test_ids_are_dense_and_hull_fits_euler(spark):
    xy = np.random.default_rng(2).random((64, 2))
    mesh = delaunay_mesh(_frame(spark, {0: xy}))
    rows = sorted((r.tri_id, r.a, r.b, r.c) for r in mesh.collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert len(rows) == 2 * 64 - 2 - hull_nodes(mesh).count()


def test_mirrors_of_the_right_hull(spark):
    xy = np.random.default_rng(3).random((40, 2))
    nodes, triangles = globe_mesh(_frame(spark, {0: xy}))
    mirrors = nodes.where("mirror_id is not null").orderBy("node_id").collect()
    assert [m.node_id for m in mirrors] == list(range(40, 40 + len(mirrors)))
    assert all(m.u == xy[m.mirror_id, 0] - 1 and xy[m.mirror_id, 0] > 0.5 for m in mirrors)
    ids = {m.node_id for m in mirrors}
    assert all(not {r.a, r.b, r.c} <= ids for r in triangles.collect())
