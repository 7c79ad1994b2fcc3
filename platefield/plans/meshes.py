"""Plans over the triangle meshes of the plates."""

from pyspark.sql import functions as F

from ..operators import delaunay as D
from ..operators import mesh as M
from ..operators import relax as X
from ..session import cut_lineage
from ..sources.bindings import PLATE_POINTS
from ..sources.bindings import RASTER_HEIGHT as H
from ..sources.plates import export_polygon_path
from .registry import query, r, rounded, rs


def globe(t, numbered=True):
    """(nodes with mirrors, triangles)."""
    return D.globe_mesh(t.nodes, numbered=numbered)


def relaxed(t):
    """(aged nodes, directions) after three rounds; nodes and neighbours are read in every round."""
    stitched, triangles = globe(t, numbered=False)
    neighbors = M.mesh_neighbors(triangles).join(
        stitched.where("mirror_id is null").select("plate_id", F.col("node_id").alias("src")),
        ["plate_id", "src"],
        "left_semi",
    )
    nodes = cut_lineage(t.with_age(stitched.where("mirror_id is null").drop("mirror_id")))
    return nodes, X.relax_directions(cut_lineage(neighbors), nodes)


@query("delaunay_mesh", "SELECT plate_id, tri_id, a, b, c FROM f_tri")
def _(t):
    return D.delaunay_mesh(t.nodes)


@query("delaunay_one_plate", "SELECT plate_id, tri_id, a, b, c FROM f_one_tri")
def _(t):
    """All points in one mesh, cut into small tiles: the way a plate with most of the rows is solved."""
    node = F.col("plate_id") * PLATE_POINTS + F.col("node_id")
    one = t.nodes.select(F.lit(0).cast("bigint").alias("plate_id"), node.alias("node_id"), "u", "v")
    return D.delaunay_mesh(one, tile_points=128)


@query("hull_nodes", "SELECT plate_id, node_id FROM f_hull")
def _(t):
    return D.hull_nodes(D.delaunay(t.nodes))


@query("stitch_seam", f"SELECT plate_id, node_id, mirror_id, {rs('u', 'v')} FROM f_stitched")
def _(t):
    return rounded(D.stitch_seam(t.nodes, D.delaunay(t.nodes)), "u", "v")


@query("globe_mesh", "SELECT plate_id, tri_id, a, b, c FROM f_globe")
def _(t):
    return globe(t)[1].select("plate_id", "tri_id", "a", "b", "c")


@query("drop_mirror_triangles", "SELECT plate_id, count(*) AS n_triangles FROM f_globe GROUP BY plate_id")
def _(t):
    return globe(t, numbered=False)[1].groupBy("plate_id").agg(F.count(F.lit(1)).alias("n_triangles"))


_PLACES = [f"{k}_{c}" for k in "abc" for c in "uv"]


@query("join_triangle_nodes", f"""
  SELECT plate_id, tri_id, a_original_id, b_original_id, c_original_id, {rs(*_PLACES)} FROM f_corner""")
def _(t):
    stitched, triangles = globe(t)
    return rounded(M.join_triangle_nodes(triangles, stitched), *_PLACES)


@query("tri_angles", f"SELECT plate_id, tri_id, {", ".join(r(f"angle_{k}", f"angle_{k}", 4) for k in "abc")} FROM f_angles")
def _(t):
    stitched, triangles = globe(t)
    out = M.triangle_measures(triangles, stitched).select("plate_id", "tri_id", "angle_a", "angle_b", "angle_c")
    return rounded(out, "angle_a", "angle_b", "angle_c", digits=4)


@query("tri_area", f"SELECT plate_id, tri_id, {r('angle_a + angle_b + angle_c - pi()', 'area', 4)} FROM f_angles")
def _(t):
    stitched, triangles = globe(t)
    return rounded(M.triangle_measures(triangles, stitched).select("plate_id", "tri_id", "area"), "area", digits=4)


@query("tri_target_size", f"""
  SELECT plate_id, tri_id, {r('angle_a + angle_b + angle_c - pi()', 'area', 4)},
         {r('(angle_a + angle_b + angle_c - pi()) * 0.2e0', 'target_size', 4)} FROM f_angles""")
def _(t):
    stitched, triangles = globe(t)
    out = M.triangle_measures(triangles, stitched, 0.2).select("plate_id", "tri_id", "area", "target_size")
    return rounded(out, "area", "target_size", digits=4)


@query("tri_center", f"""
  SELECT plate_id, tri_id, {r('(a_u + b_u + c_u) / 3', 'center_u')}, {r('(a_v + b_v + c_v) / 3', 'center_v')} FROM f_shown""")
def _(t):
    stitched, triangles = globe(t)
    out = M.triangle_centers(triangles, stitched).select("plate_id", "tri_id", "center_u", "center_v")
    return rounded(out, "center_u", "center_v")


def _pull(c: str) -> str:
    mean = f"(a_{c} + b_{c} + c_{c}) / 3"
    return " + ".join(f"({k}_{c} - {mean}) * {k}_age" for k in "abc")


@query("tri_direction", f"SELECT plate_id, tri_id, {r(_pull('u'), 'dir_u')}, {r(_pull('v'), 'dir_v')} FROM f_shown")
def _(t):
    stitched, triangles = globe(t)
    return rounded(M.triangle_directions(triangles, t.with_age(stitched)), "dir_u", "dir_v")


@query("tri_age", f"""
  SELECT t.plate_id, t.tri_id, {r('(a.age + b.age + c.age) / 3', 'age')} FROM f_corner t
  JOIN f_aged a ON a.plate_id = t.plate_id AND a.node_id = a_original_id
  JOIN f_aged b ON b.plate_id = t.plate_id AND b.node_id = b_original_id
  JOIN f_aged c ON c.plate_id = t.plate_id AND c.node_id = c_original_id""")
def _(t):
    stitched, triangles = globe(t)
    return rounded(M.triangle_ages(triangles, t.with_age(stitched)), "age")


@query("mesh_neighbors", "SELECT plate_id, src, dst FROM f_nbr")
def _(t):
    return M.mesh_neighbors(globe(t, numbered=False)[1])


_HALF = """
  SELECT h.*, w.edge_id AS twin FROM f_tri_he h
  LEFT JOIN f_tri_he w ON w.plate_id = h.plate_id AND w.p = h.q AND w.q = h.p"""


@query("mesh_edges", f"""
  SELECT h.plate_id, h.edge_id, h.p AS start_id, h.q AS end_id, {r('s.u', 'start_u')}, {r('s.v', 'start_v')}, {r('e.u', 'end_u')}, {r('e.v', 'end_v')}
  FROM ({_HALF}) h JOIN f_nodes s ON s.plate_id = h.plate_id AND s.node_id = h.p
  JOIN f_nodes e ON e.plate_id = h.plate_id AND e.node_id = h.q
  WHERE h.edge_id > coalesce(h.twin, -1)""")
def _(t):
    return rounded(M.mesh_edges(D.delaunay_mesh(t.nodes), t.nodes), "start_u", "start_v", "end_u", "end_v")


@query("mesh_half_edges", "SELECT plate_id, edge_id, tri_id, next_id, prev_id, p, q FROM f_tri_he")
def _(t):
    return M.half_edges(D.delaunay_mesh(t.nodes))


@query("mesh_adjacent_triangles", f"""
  SELECT h.plate_id, h.tri_id, h.twin // 3 AS adjacent_id FROM ({_HALF}) h WHERE h.twin IS NOT NULL""")
def _(t):
    return M.mesh_adjacent_triangles(D.delaunay_mesh(t.nodes))


@query("mesh_edges_around_point", f"""
  WITH RECURSIVE half AS MATERIALIZED ({_HALF}),
  step1 AS MATERIALIZED (
    SELECT h.plate_id, h.edge_id, n.twin AS onward, h.q FROM half h JOIN half n ON n.plate_id = h.plate_id AND n.edge_id = h.next_id),
  walk AS (
    SELECT plate_id, min(edge_id) AS start_edge, q AS node_id, 0 AS step, min(edge_id) AS edge_id FROM half GROUP BY plate_id, q
    UNION ALL
    SELECT w.plate_id, w.start_edge, w.node_id, w.step + 1, s.onward FROM walk w
    JOIN step1 s ON s.plate_id = w.plate_id AND s.edge_id = w.edge_id
    WHERE s.onward IS NOT NULL AND s.onward <> w.start_edge)
  SELECT plate_id, start_edge, node_id, step, edge_id FROM walk""")
def _(t):
    triangles = cut_lineage(D.delaunay_mesh(t.nodes))
    starts = M.half_edges(triangles).groupBy("plate_id", "q").agg(F.min("edge_id").alias("start_edge"))
    return M.mesh_edges_around_point(triangles, t.nodes, starts.select("plate_id", "start_edge"))


@query("mesh_index_buffer", """
  SELECT plate_id, 0 AS part, string_agg(c || ' ' || b || ' ' || a, ' ' ORDER BY tri_id) AS indices FROM f_globe GROUP BY plate_id""")
def _(t):
    out = M.mesh_index_buffer(globe(t)[1])
    return out.select(
        "plate_id", F.col("part").cast("int").alias("part"),
        F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"),
    )


_PIXEL = "floor({} * 200e0 + 0.5e0)::BIGINT / 100e0"
_PIXEL_V = "floor((1e0 - {}) * 100e0 + 0.5e0)::BIGINT / 100e0"


def _number(e: str) -> str:
    return f"(CASE WHEN {e} = floor({e}) THEN ({e})::BIGINT::VARCHAR ELSE ({e})::VARCHAR END)"


def _path_point(k: str) -> str:
    return f"{_number(_PIXEL.format(k + '_u'))} || ',' || {_number(_PIXEL_V.format(k + '_v'))}"


@query("export_polygon_path", f"""
  SELECT plate_id, tri_id, {" || ' ' || ".join(_path_point(k) for k in 'abc')} AS path FROM f_shown""")
def _(t):
    stitched, triangles = globe(t)
    shown = M.join_corners(triangles, stitched, ["u", "v"])
    corner = lambda i, k: F.struct(F.lit(i).alias("i"), F.col(f"{k}_u").alias("u"), F.col(f"{k}_v").alias("v"))
    corners = shown.select("plate_id", "tri_id", F.explode(F.array(*[corner(i, k) for i, k in enumerate("abc")])).alias("p"))
    return export_polygon_path(corners.select("plate_id", "tri_id", "p.*"), ["plate_id", "tri_id"], "i", H)


@query("avg_point", f"""
  SELECT plate_id, {r('avg(u)', 'center_u')}, {r('avg(v)', 'center_v')}, {r('avg(x)', 'center_x')}, {r('avg(y)', 'center_y')}, {r('avg(z)', 'center_z')}
  FROM f_point GROUP BY plate_id""")
def _(t):
    from .points import _xyz

    names = ["u", "v", "x", "y", "z"]
    return rounded(M.average_points(_xyz(t.nodes), ["plate_id"], names), *[f"center_{n}" for n in names])


@query("plate_center_offset", f"""
  SELECT plate_id, {r('avg(n.u)', 'center_u')}, {r('avg(n.v)', 'center_v')},
         {r('avg(n.u) - any_value(z.u)', 'offset_u')}, {r('avg(n.v) - any_value(z.v)', 'offset_v')}
  FROM f_nodes n JOIN (SELECT plate_id, u, v FROM f_nodes WHERE node_id = 0) z USING (plate_id) GROUP BY plate_id""")
def _(t):
    targets = t.nodes.where("node_id = 0").select(
        "plate_id", F.col("u").alias("target_u"), F.col("v").alias("target_v")
    )
    return rounded(M.plate_center_offset(t.nodes, targets), "center_u", "center_v", "offset_u", "offset_v")


@query("relax_directions", f"""
  SELECT n.plate_id, n.node_id, {rs('dx', 'dy', 'dz')} FROM f_nodes n LEFT JOIN f_d3 USING (plate_id, node_id)""")
def _(t):
    return rounded(relaxed(t)[1], "dx", "dy", "dz")


@query("drop_zero_directions", f"""
  SELECT plate_id, node_id, {rs('dx', 'dy', 'dz')} FROM f_d3 WHERE dx <> 0 OR dy <> 0 OR dz <> 0""")
def _(t):
    return rounded(X.drop_zero_directions(relaxed(t)[1]), "dx", "dy", "dz")


@query("displacement_segments", f"""
  SELECT plate_id, node_id, floor(u * 200e0 + 0.5e0) / 100e0 AS x1, floor((1e0 - v) * 100e0 + 0.5e0) / 100e0 AS y1,
         floor((0.5e0 + atan2(ex, ez) / (2 * pi())) * 200e0 + 0.5e0) / 100e0 AS x2,
         floor((1e0 - (0.5e0 + asin(ey) / pi())) * 100e0 + 0.5e0) / 100e0 AS y2
  FROM (SELECT *, x - dx AS ex, CASE WHEN abs(y - dy) <= 1 THEN y - dy END AS ey, z - dz AS ez
        FROM f_point JOIN f_d3 USING (plate_id, node_id) WHERE dx <> 0 OR dy <> 0 OR dz <> 0)""")
def _(t):
    nodes, directions = relaxed(t)
    return X.displacement_segments(nodes, directions, H)
