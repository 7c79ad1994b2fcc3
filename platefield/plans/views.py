"""Subqueries shared by the check queries: the fixtures and the mesh, written for SQL."""

from ..sources.bindings import DAY0_MICROS, PLATE_POINTS, RASTER_HEIGHT, RASTER_WIDTH
from .registry import view

view("f_edits", f"""
  SELECT user_id AS plate_id, event_id AS seq, ts, event_type AS op,
         (epoch_us(ts) - {DAY0_MICROS}) / 2592000000000e0 AS time,
         value / 500e0 AS u, k / 100e0 AS v, value, k
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""")
view("f_pair", "SELECT unnest([0, 1]) AS point_idx")
view("f_base", """
  SELECT plate_id, point_idx, CASE point_idx WHEN 0 THEN u ELSE v END AS u, CASE point_idx WHEN 0 THEN v ELSE u END AS v
  FROM (SELECT plate_id, arg_min(u, seq) AS u, arg_min(v, seq) AS v FROM f_edits GROUP BY plate_id), f_pair""")
view("f_kf", """
  SELECT plate_id, seq AS kf_seq, time, point_idx,
         CASE point_idx WHEN 0 THEN u ELSE v END AS u, CASE point_idx WHEN 0 THEN v ELSE u END AS v
  FROM f_edits, f_pair""")
view("f_nodes", f"""
  SELECT vec_id // {PLATE_POINTS} AS plate_id, vec_id % {PLATE_POINTS} AS node_id,
         atan2(x / n, z / n) / (2e0 * pi()) + 0.5e0 AS u, asin(y / n) / pi() + 0.5e0 AS v
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n
        FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z
              FROM embeddings))""")
view("f_puts", f"""
  SELECT 0 AS raster_id, seq, (plate_id % {RASTER_WIDTH})::INT AS px, k AS py,
         (floor(value)::BIGINT % 256)::SMALLINT AS r, ((k * 2) % 256)::SMALLINT AS g,
         (plate_id % 256)::SMALLINT AS b, 255::SMALLINT AS a FROM f_edits""")
view("f_raster", """
  SELECT raster_id, px, py, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b, arg_max(a, seq) AS a
  FROM f_puts GROUP BY raster_id, px, py""")


def _aged(nodes: str) -> str:
    x = f"greatest(0, least({RASTER_WIDTH - 1}, floor(u * {2 * RASTER_HEIGHT}e0 + 0.5e0)))"
    y = f"greatest(0, least({RASTER_HEIGHT - 1}, floor((1e0 - v) * {RASTER_HEIGHT}e0 + 0.5e0)))"
    return f"""
      SELECT n.*, coalesce(p.r, 0) / 256e0 AS age
      FROM (SELECT *, {x}::INT AS px, {y}::INT AS py FROM {nodes}) n LEFT JOIN f_raster p USING (px, py)"""


def _delaunay(name: str, nodes: str) -> None:
    """Keep a triple when each directed edge chooses the opposite corner as its best apex."""
    view(f"{name}_p", f"SELECT plate_id, min(node_id) AS id, u, v FROM {nodes} GROUP BY plate_id, u, v")
    view(f"{name}_apex", f"""
      SELECT plate_id, a, b, arg_min(c, dot / turn) AS c
      FROM (SELECT p.plate_id, p.id AS a, q.id AS b, s.id AS c,
                   (p.u - s.u) * (q.v - s.v) - (p.v - s.v) * (q.u - s.u) AS turn,
                   (p.u - s.u) * (q.u - s.u) + (p.v - s.v) * (q.v - s.v) AS dot
            FROM {name}_p p JOIN {name}_p q ON p.plate_id = q.plate_id AND p.id <> q.id
                 JOIN {name}_p s ON s.plate_id = p.plate_id AND s.id <> p.id AND s.id <> q.id)
      WHERE turn > 0 GROUP BY plate_id, a, b""")
    view(f"{name}_abc", f"""
      SELECT d.plate_id, d.a, d.b, d.c FROM {name}_apex d
      JOIN {name}_apex e ON e.plate_id = d.plate_id AND e.a = d.b AND e.b = d.c AND e.c = d.a
      JOIN {name}_apex f ON f.plate_id = d.plate_id AND f.a = d.c AND f.b = d.a AND f.c = d.b
      WHERE d.a < d.b AND d.a < d.c""")
    view(name, f"""
      SELECT plate_id, row_number() OVER (PARTITION BY plate_id ORDER BY a, b, c) - 1 AS tri_id, a, b, c
      FROM {name}_abc""")
    view(f"{name}_he", f"""
      SELECT plate_id, tri_id, tri_id * 3 + k AS edge_id,
             tri_id * 3 + (k + 1) % 3 AS next_id, tri_id * 3 + (k + 2) % 3 AS prev_id,
             CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS p, CASE k WHEN 0 THEN b WHEN 1 THEN c ELSE a END AS q
      FROM {name}, (SELECT unnest([0, 1, 2]) AS k)""")


_delaunay("f_tri", "f_nodes")
view("f_hull", """
  SELECT DISTINCT h.plate_id, unnest([h.p, h.q]) AS node_id FROM f_tri_he h
  WHERE NOT EXISTS (SELECT 1 FROM f_tri_he t WHERE t.plate_id = h.plate_id AND t.p = h.q AND t.q = h.p)""")
view("f_stitched", """
  SELECT plate_id, node_id, NULL::BIGINT AS mirror_id, u, v FROM f_nodes
  UNION ALL
  SELECT plate_id, n + row_number() OVER (PARTITION BY plate_id ORDER BY node_id) - 1, node_id, u - 1, v
  FROM f_nodes JOIN f_hull USING (plate_id, node_id)
       JOIN (SELECT plate_id, max(node_id) + 1 AS n FROM f_nodes GROUP BY plate_id) USING (plate_id)
  WHERE u > 0.5""")
_delaunay("f_all", "f_stitched")
view("f_globe", """
  SELECT t.* FROM f_all t WHERE (
    SELECT count(m.mirror_id) FROM f_stitched m
    WHERE m.plate_id = t.plate_id AND m.node_id IN (t.a, t.b, t.c)) < 3""")
view("f_res", """
  SELECT n.plate_id, n.node_id, o.node_id AS original_id, o.u, o.v
  FROM f_stitched n JOIN f_nodes o ON o.plate_id = n.plate_id AND o.node_id = coalesce(n.mirror_id, n.node_id)""")
view("f_one", f"SELECT 0::BIGINT AS plate_id, plate_id * {PLATE_POINTS} + node_id AS node_id, u, v FROM f_nodes")
_delaunay("f_one_tri", "f_one")
view("f_aged", _aged("f_nodes"))
view("f_stitched_aged", _aged("f_stitched"))


def xyz(prefix: str, u: str, v: str) -> str:
    """Sphere point columns of a uv."""
    lon = f"(2e0 * pi() * (CASE WHEN {u} < 0 THEN {u} + 1 ELSE {u} END))"
    lat = f"(pi() * ({v} - 0.5e0))"
    return (
        f"-cos({lat}) * sin({lon}) AS {prefix}x, sin({lat}) AS {prefix}y, -cos({lat}) * cos({lon}) AS {prefix}z"
    )


view("f_corner", f"""
  SELECT t.plate_id, t.tri_id, t.a, t.b, t.c,
         a.original_id AS a_original_id, b.original_id AS b_original_id, c.original_id AS c_original_id,
         a.u AS a_u, a.v AS a_v, b.u AS b_u, b.v AS b_v, c.u AS c_u, c.v AS c_v
  FROM f_globe t JOIN f_res a ON a.plate_id = t.plate_id AND a.node_id = t.a
       JOIN f_res b ON b.plate_id = t.plate_id AND b.node_id = t.b
       JOIN f_res c ON c.plate_id = t.plate_id AND c.node_id = t.c""")
view("f_corner_xyz", f"""
  SELECT *, {xyz('pa', 'a_u', 'a_v')}, {xyz('pb', 'b_u', 'b_v')}, {xyz('pc', 'c_u', 'c_v')} FROM f_corner""")


def angle(a: str, b: str, c: str) -> str:
    """Spherical angle at b of points given by column prefixes."""

    def cross(p, q):
        return (
            f"({p}y * {q}z - {p}z * {q}y)", f"({p}z * {q}x - {p}x * {q}z)", f"({p}x * {q}y - {p}y * {q}x)"
        )

    m, n = cross(a, b), cross(c, b)
    dot = lambda p, q: "(" + " + ".join(f"{i} * {j}" for i, j in zip(p, q)) + ")"
    cosine = f"({dot(m, n)} / nullif(sqrt({dot(m, m)}) * sqrt({dot(n, n)}), 0))"
    return f"acos(CASE WHEN {cosine} > 1 THEN 1e0 WHEN {cosine} < -1 THEN -1e0 ELSE {cosine} END)"


view("f_angles", f"""
  SELECT plate_id, tri_id, {angle('pb', 'pa', 'pc')} AS angle_a, {angle('pa', 'pb', 'pc')} AS angle_b,
         {angle('pb', 'pc', 'pa')} AS angle_c FROM f_corner_xyz""")
view("f_shown", """
  SELECT t.plate_id, t.tri_id, a.u AS a_u, a.v AS a_v, b.u AS b_u, b.v AS b_v, c.u AS c_u, c.v AS c_v,
         a.age AS a_age, b.age AS b_age, c.age AS c_age
  FROM f_globe t JOIN f_stitched_aged a ON a.plate_id = t.plate_id AND a.node_id = t.a
       JOIN f_stitched_aged b ON b.plate_id = t.plate_id AND b.node_id = t.b
       JOIN f_stitched_aged c ON c.plate_id = t.plate_id AND c.node_id = t.c""")
view("f_nbr", """
  SELECT DISTINCT s.plate_id, s.src, coalesce(n.mirror_id, n.node_id) AS dst
  FROM (SELECT plate_id, tri_id, unnest([node_id, mirror_id]) AS src
        FROM f_all_he JOIN f_stitched USING (plate_id) WHERE node_id = p) s
       JOIN f_globe t USING (plate_id, tri_id)
       JOIN f_stitched n ON n.plate_id = s.plate_id AND n.node_id IN (t.a, t.b, t.c)
  WHERE s.src IS NOT NULL AND s.src <> coalesce(n.mirror_id, n.node_id)""")
view("f_point", f"SELECT plate_id, node_id, u, v, age, {xyz('', 'u', 'v')} FROM f_aged")
view("f_push", """
  SELECT n.plate_id, n.src AS node_id, count(*) AS degree,
         sum((p.x - q.x) * greatest(0, p.age - q.age)) AS px,
         sum((p.y - q.y) * greatest(0, p.age - q.age)) AS py,
         sum((p.z - q.z) * greatest(0, p.age - q.age)) AS pz
  FROM f_nbr n JOIN f_point p ON p.plate_id = n.plate_id AND p.node_id = n.src
       JOIN f_point q ON q.plate_id = n.plate_id AND q.node_id = n.dst
  GROUP BY n.plate_id, n.src""")
view("f_d1", "SELECT plate_id, node_id, degree, px, py, pz, px / degree AS dx, py / degree AS dy, pz / degree AS dz FROM f_push")
for _before, _after in (("f_d1", "f_d2"), ("f_d2", "f_d3")):
    view(_after, f"""
      SELECT s.plate_id, s.node_id, s.degree, s.px, s.py, s.pz,
             (s.dx + s.px + t.tx) / s.degree AS dx, (s.dy + s.py + t.ty) / s.degree AS dy,
             (s.dz + s.pz + t.tz) / s.degree AS dz
      FROM {_before} s JOIN (
        SELECT n.plate_id, n.src AS node_id, sum(dx) AS tx, sum(dy) AS ty, sum(dz) AS tz
        FROM f_nbr n JOIN {_before} d ON d.plate_id = n.plate_id AND d.node_id = n.dst
        GROUP BY n.plate_id, n.src) t USING (plate_id, node_id)""")
view("f_grid_t", "SELECT unnest(generate_series(0, 10)) / 10e0 AS t")
view("f_asked", "SELECT plate_id, t FROM (SELECT DISTINCT plate_id FROM f_edits), f_grid_t")
view("f_frames", "SELECT DISTINCT plate_id, kf_seq, time FROM f_kf")
view("f_ends", """
  SELECT plate_id, first(kf_seq ORDER BY time, kf_seq DESC) AS s0, min(time) AS t0,
         first(kf_seq ORDER BY time DESC, kf_seq DESC) AS s1, max(time) AS t1
  FROM f_frames GROUP BY plate_id""")
view("f_extreme", """
  SELECT q.plate_id, q.t, CASE WHEN t0 <= t THEN s0 ELSE -1 END AS ls, CASE WHEN t0 <= t THEN t0 ELSE 0e0 END AS lt,
         CASE WHEN t1 >= t THEN s1 END AS us, CASE WHEN t1 >= t THEN t1 END AS ut
  FROM f_asked q LEFT JOIN f_ends USING (plate_id)""")
view("f_bracket", """
  SELECT q.plate_id, q.t, coalesce(l.s, -1) AS ls, coalesce(l.time, 0e0) AS lt, h.s AS us, h.time AS ut
  FROM f_asked q
  LEFT JOIN (SELECT plate_id, t, first(kf_seq ORDER BY time DESC, kf_seq DESC) AS s, max(time) AS time
             FROM f_asked JOIN f_frames USING (plate_id) WHERE time <= t GROUP BY plate_id, t) l USING (plate_id, t)
  LEFT JOIN (SELECT plate_id, t, first(kf_seq ORDER BY time, kf_seq DESC) AS s, min(time) AS time
             FROM f_asked JOIN f_frames USING (plate_id) WHERE time >= t GROUP BY plate_id, t) h USING (plate_id, t)""")
view("f_points", """
  SELECT plate_id, kf_seq, point_idx, u, v FROM f_kf
  UNION ALL SELECT plate_id, -1, point_idx, u, v FROM f_base""")


def interpolated(frames: str) -> str:
    alpha = "(t - lt) / CASE WHEN coalesce(ut, lt) - lt = 0 THEN 1e0 ELSE coalesce(ut, lt) - lt END"
    return f"""
      SELECT f.plate_id, f.t, p.point_idx, p.u + (coalesce(q.u, p.u) - p.u) * ({alpha}) AS u,
             p.v + (coalesce(q.v, p.v) - p.v) * ({alpha}) AS v
      FROM {frames} f JOIN f_points p ON p.plate_id = f.plate_id AND p.kf_seq = f.ls
      LEFT JOIN f_points q ON q.plate_id = f.plate_id AND q.kf_seq = coalesce(f.us, f.ls) AND q.point_idx = p.point_idx"""


for _op in ("signup", "click", "purchase", "view", "error"):
    view(f"f_first_{_op}", f"""
      SELECT * FROM f_edits WHERE op = '{_op}'
      QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY seq) = 1""")
