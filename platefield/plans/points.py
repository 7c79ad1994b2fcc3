"""Plans over points, colours, rasters, generators and documents."""

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import numeric as N
from ..functions import sphere as S
from ..operators import generate as G
from ..operators import raster as R
from ..operators import tiles as TI
from ..session import cut_lineage, scratch_path
from ..sources import images as I
from ..sources import plates as P
from ..sources.bindings import RASTER_HEIGHT as H
from ..sources.bindings import RASTER_WIDTH as W
from .registry import ORACLE, query, r, rounded, rs
from .views import angle, xyz


def _xyz(df, prefix=""):
    axes = S.uv_to_xyz(F.col("u"), F.col("v"))
    return df.withColumns({f"{prefix}{k}": c for k, c in zip("xyz", axes)})


# --- projections -----------------------------------------------------------


@query("project_uv_to_xyz", f"SELECT plate_id, node_id, {rs('x', 'y', 'z')} FROM (SELECT *, {xyz('', 'u', 'v')} FROM f_nodes)")
def _(t):
    return rounded(_xyz(t.nodes).select("plate_id", "node_id", "x", "y", "z"), "x", "y", "z")


@query("project_xyz_to_uv", f"SELECT plate_id, node_id, {rs('u', 'v')} FROM f_nodes")
def _(t):
    return rounded(t.nodes, "u", "v")


@query("project_uv_to_pixel", f"""
  SELECT plate_id, kf_seq, point_idx, floor(u * {2 * H}e0 + 0.5e0)::BIGINT AS px,
         floor((1e0 - v) * {H}e0 + 0.5e0)::BIGINT AS py FROM f_kf""")
def _(t):
    px, py = S.uv_to_pixel(F.col("u"), F.col("v"), H)
    return t.keyframes.select("plate_id", "kf_seq", "point_idx", px.alias("px"), py.alias("py"))


@query("project_pixel_to_uv", f"SELECT raster_id, px, py, {r(f'px / {2 * H}e0', 'u')}, {r(f'1e0 - py / {H}e0', 'v')} FROM f_raster")
def _(t):
    u, v = S.pixel_to_uv(F.col("px"), F.col("py"), H)
    return rounded(t.raster.select("raster_id", "px", "py", u.alias("u"), v.alias("v")), "u", "v")


def _legs(t):
    """Each node with the next one of its plate."""
    start = _xyz(t.nodes, "a")
    end = _xyz(t.nodes, "b").select("plate_id", (F.col("node_id") - 1).alias("node_id"), "bx", "by", "bz")
    return start.join(end, ["plate_id", "node_id"])


_LEGS = f"""(
  SELECT a.plate_id, a.node_id, a.sx, a.sy, a.sz, b.ex, b.ey, b.ez
  FROM (SELECT *, {xyz('s', 'u', 'v')} FROM f_nodes) a
  JOIN (SELECT *, {xyz('e', 'u', 'v')} FROM f_nodes) b ON a.plate_id = b.plate_id AND b.node_id = a.node_id + 1)"""


@query("geo_distance", f"""
  SELECT plate_id, node_id, {r('acos(sx * ex + sy * ey + sz * ez)', 'angle')},
         {r('asin(sqrt((sx - ex) * (sx - ex) + (sy - ey) * (sy - ey) + (sz - ez) * (sz - ez)) / 2)', 'half_angle')}
  FROM {_LEGS}""")
def _(t):
    a, b = S.vec("a"), S.vec("b")
    out = _legs(t).select(
        "plate_id", "node_id",
        S.great_circle_angle(a, b).alias("angle"),
        S.chord_half_angle(S.length(S.sub(a, b))).alias("half_angle"),
    )
    return rounded(out, "angle", "half_angle")


@query("geo_degrees", f"""
  SELECT plate_id, node_id, {r('degrees(2 * pi() * (u - 0.5e0))', 'lon')}, {r('degrees(pi() * (v - 0.5e0))', 'lat')},
         {r('radians(u * 360e0)', 'rad')} FROM f_nodes""")
def _(t):
    turn = (F.col("u") - 0.5) * 2.0 * F.pi()
    out = t.nodes.select(
        "plate_id", "node_id", F.degrees(turn).alias("lon"),
        F.degrees((F.col("v") - 0.5) * F.pi()).alias("lat"), F.radians(F.col("u") * 360.0).alias("rad"),
    )
    return rounded(out, "lon", "lat", "rad")


@query("geo_intermediate", f"""
  SELECT plate_id, node_id, fraction, {r('sx * (1 - fraction) + ex * fraction', 'x')},
         {r('sy * (1 - fraction) + ey * fraction', 'y')}, {r('sz * (1 - fraction) + ez * fraction', 'z')}
  FROM {_LEGS}, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS fraction)""")
def _(t):
    steps = F.array(*[F.lit(f) for f in (0.0, 0.25, 0.5, 0.75, 1.0)])
    at = F.col("fraction")
    out = _legs(t).withColumn("fraction", F.explode(steps)).select(
        "plate_id", "node_id", "fraction",
        *[S.lerp(F.col(f"a{k}"), F.col(f"b{k}"), at).alias(k) for k in "xyz"],
    )
    return rounded(out, "x", "y", "z")


@query("uv_lerp", f"""
  SELECT a.plate_id, a.node_id, age, {r('a.u + (b.u - a.u) * age', 'u')}, {r('a.v + (b.v - a.v) * age', 'v')}
  FROM f_nodes a JOIN f_nodes b ON a.plate_id = b.plate_id AND b.node_id = a.node_id + 1,
       (SELECT unnest([0e0, 0.3e0, 1e0]) AS age)""")
def _(t):
    end = t.nodes.select("plate_id", (F.col("node_id") - 1).alias("node_id"), F.col("u").alias("eu"), F.col("v").alias("ev"))
    age = F.col("age")
    out = (
        t.nodes.join(end, ["plate_id", "node_id"])
        .withColumn("age", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0))))
        .select(
            "plate_id", "node_id", "age",
            (F.col("u") + (F.col("eu") - F.col("u")) * age).alias("u"),
            (F.col("v") + (F.col("ev") - F.col("v")) * age).alias("v"),
        )
    )
    return rounded(out, "u", "v")


# --- colours ---------------------------------------------------------------


@query("color_hex", """
  SELECT raster_id, px, py, format('#{:02x}{:02x}{:02x}', r, g, b) AS hex, r, g, b, py AS a FROM f_raster""")
def _(t):
    r_, g, b, a = C.with_alpha(F.col("r"), F.col("g"), F.col("b"), F.col("py"))
    return t.raster.select(
        "raster_id", "px", "py", C.hex_color(r_, g, b).alias("hex"), r_, g, b, a.alias("a")
    )


def _hsl_channel(shift: str, name: str) -> str:
    turn = f"(hue / 360e0 + {shift})"
    h = f"(CASE WHEN {turn} < 0 THEN {turn} + 1 WHEN {turn} > 1 THEN {turn} - 1 ELSE {turn} END)"
    return (
        f"floor((CASE WHEN 6e0 * {h} < 1 THEN 6e0 * {h} WHEN 2e0 * {h} < 1 THEN 1e0 "
        f"WHEN 3e0 * {h} < 2 THEN (2e0 / 3e0 - {h}) * 6e0 ELSE 0e0 END) * 255e0 + 0.5e0)::INT AS {name}"
    )


RAMP = f"{_hsl_channel('1e0 / 3e0', 'r')}, {_hsl_channel('0e0', 'g')}, {_hsl_channel('-1e0 / 3e0', 'b')}"


@query("color_age_ramp", f"""
  SELECT plate_id, seq, {RAMP}, 255 AS a FROM (SELECT plate_id, seq, floor(time * 255e0 + 0.5e0) AS hue FROM f_edits)""")
def _(t):
    red, green, blue = C.hue_to_rgb(C.age_hue(F.col("time")))
    return t.edits.select(
        "plate_id", "seq", red.alias("r"), green.alias("g"), blue.alias("b"), F.lit(255).alias("a")
    )


@query("age_label", """
  SELECT plate_id, seq, lpad(s, greatest(3, length(s))::INT, ' ') AS label
  FROM (SELECT plate_id, seq, floor(time * value * 280e0 + 0.5e0)::BIGINT::VARCHAR AS s FROM f_edits)""")
def _(t):
    return t.edits.select("plate_id", "seq", C.age_label(F.col("time") * F.col("value")).alias("label"))


# --- the math surface --------------------------------------------------------

_X, _D, _Q = "(l_extendedprice / 100000e0)", "l_discount", "l_quantity"
_MATH = {
    # name: (Spark expression of x, d, q; SQL)
    "abs": (lambda x, d, q: F.abs(x - 0.5), f"abs({_X} - 0.5e0)"),
    "acos": (lambda x, d, q: F.acos(d), f"acos({_D})"),
    "acosh": (lambda x, d, q: F.acosh(q), f"acosh({_Q})"),
    "asin": (lambda x, d, q: F.asin(d), f"asin({_D})"),
    "asinh": (lambda x, d, q: F.asinh(x), f"asinh({_X})"),
    "atan": (lambda x, d, q: F.atan(x), f"atan({_X})"),
    "atan2": (lambda x, d, q: F.atan2(x, q), f"atan2({_X}, {_Q})"),
    "atanh": (lambda x, d, q: F.atanh(d), f"atanh({_D})"),
    "cbrt": (lambda x, d, q: F.cbrt(q), f"cbrt({_Q})"),
    "ceil": (lambda x, d, q: F.ceil(x * 10.0).cast("double"), f"ceil({_X} * 10e0)"),
    "clz32": (lambda x, d, q: N.clz32(q).cast("double"), f"(32 - length(bin({_Q}::INT)))::DOUBLE"),
    "cos": (lambda x, d, q: F.cos(x), f"cos({_X})"),
    "cosh": (lambda x, d, q: F.cosh(x), f"cosh({_X})"),
    "exp": (lambda x, d, q: F.exp(x), f"exp({_X})"),
    "expm1": (lambda x, d, q: F.expm1(d), f"exp({_D}) - 1e0"),
    "floor": (lambda x, d, q: F.floor(x * 10.0).cast("double"), f"floor({_X} * 10e0)"),
    "fround": (lambda x, d, q: x.cast("float").cast("double"), f"{_X}::FLOAT::DOUBLE"),
    "hypot": (lambda x, d, q: F.hypot(x, q), f"sqrt({_X} * {_X} + {_Q} * {_Q})"),
    "log": (lambda x, d, q: F.ln(q), f"ln({_Q})"),
    "log10": (lambda x, d, q: F.log10(q), f"log10({_Q})"),
    "log1p": (lambda x, d, q: F.log1p(d), f"ln(1e0 + {_D})"),
    "log2": (lambda x, d, q: F.log2(q), f"log2({_Q})"),
    "max": (lambda x, d, q: F.greatest(x, d), f"greatest({_X}, {_D})"),
    "min": (lambda x, d, q: F.least(x, d), f"least({_X}, {_D})"),
    "pow": (lambda x, d, q: F.pow(x, d), f"pow({_X}, {_D})"),
    "round": (lambda x, d, q: N.half_up(x * 10.0 - 5.0).cast("double"), f"floor({_X} * 10e0 - 5e0 + 0.5e0)"),
    "sign": (lambda x, d, q: F.sign(x - 0.5), f"sign({_X} - 0.5e0)::DOUBLE"),
    "sin": (lambda x, d, q: F.sin(x), f"sin({_X})"),
    "sinh": (lambda x, d, q: F.sinh(x), f"sinh({_X})"),
    "sqrt": (lambda x, d, q: F.sqrt(x), f"sqrt({_X})"),
    "tan": (lambda x, d, q: F.tan(x), f"tan({_X})"),
    "tanh": (lambda x, d, q: F.tanh(x), f"tanh({_X})"),
    "trunc": (lambda x, d, q: N.trunc(x * 10.0 - 5.0), f"trunc({_X} * 10e0 - 5e0)"),
}
_CONSTANTS = {
    "e": "exp(1e0)", "ln10": "ln(10e0)", "ln2": "ln(2e0)", "log10e": "log10(exp(1e0))",
    "log2e": "log2(exp(1e0))", "pi": "pi()", "sqrt1_2": "sqrt(0.5e0)", "sqrt2": "sqrt(2e0)",
}
_WRAP = "((l_orderkey * 65537 % 4294967296) * (l_partkey * 40503 % 4294967296)::HUGEINT % 4294967296)"


@query("math_projection", "SELECT l_orderkey, l_linenumber, "
       + ", ".join(r(s, f"f_{k}", 9) for k, (_, s) in _MATH.items()) + ", "
       + f"CASE WHEN {_WRAP} >= 2147483648 THEN {_WRAP} - 4294967296 ELSE {_WRAP} END::BIGINT AS f_imul, "
       + ", ".join(r(s, f"c_{k}", 9) for k, s in _CONSTANTS.items()) + " FROM lineitem")
def _(t):
    import math

    x, d, q = F.col("l_extendedprice") / 100000.0, F.col("l_discount"), F.col("l_quantity")
    values = {
        "e": math.e, "ln10": math.log(10), "ln2": math.log(2), "log10e": math.log10(math.e),
        "log2e": math.log2(math.e), "pi": math.pi, "sqrt1_2": math.sqrt(0.5), "sqrt2": math.sqrt(2),
    }
    functions = {f"f_{k}": fn(x, d, q) for k, (fn, _) in _MATH.items()}
    constants = {f"c_{k}": F.lit(v) for k, v in values.items()}
    out = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        *[c.alias(k) for k, c in functions.items()],
        N.imul(F.col("l_orderkey") * 65537, F.col("l_partkey") * 40503).alias("f_imul"),
        *[c.alias(k) for k, c in constants.items()],
    )
    return rounded(out, *functions, *constants, digits=9)


# --- rasters -----------------------------------------------------------------


def _run(c: str, old: int, new: int, name: str) -> str:
    first = lambda k: f"ceil({k} * {new}e0 / {old}e0 - 0.5e0)::INT"
    return f"unnest(range({first(c)}, {first(f'({c} + 1)')})) AS {name}"


@query("scan_raster", f"""
  SELECT raster_id, x::INT AS px, y::INT AS py, r, g, b, a FROM (
    SELECT *, {_run('py', H, 150, 'y')} FROM (SELECT *, {_run('px', W, 120, 'x')} FROM f_raster))""")
def _(t):
    return R.resize_nearest(t.raster, W, H, 120, 150)


@query("scan_raster_files", f"""
  SELECT raster_id, x::INT AS px, y::INT AS py, r, g, b, 255::SMALLINT AS a FROM (
    SELECT *, {_run('py', H, 150, 'y')} FROM (
      SELECT *, {_run('px', W, 120, 'x')} FROM (
        SELECT raster_id, px, py, coalesce(r, 0)::SMALLINT AS r, coalesce(g, 0)::SMALLINT AS g, coalesce(b, 0)::SMALLINT AS b
        FROM (SELECT * FROM (SELECT DISTINCT raster_id FROM f_raster), (SELECT unnest(range({W})) AS px), (SELECT unnest(range({H})) AS py))
        LEFT JOIN f_raster USING (raster_id, px, py))))""")
def _(t):
    # The raster as an image file that the executors wrote.
    path = scratch_path(t.spark, "images")
    I.write_bitmaps(t.raster, path, W, H)
    found = I.scan_raster(t.spark, path, 120, 150)
    named = F.regexp_extract("origin", "raster_id=([0-9]+)", 1).cast("int")
    return found.select(named.alias("raster_id"), "px", "py", "r", "g", "b", "a")


_CX = f"greatest(0, least({W - 1}, px))::INT"
_CY = f"greatest(0, least({H - 1}, py))::INT"


@query("raster_put", f"""
  SELECT raster_id, px, py, coalesce(n.r, o.r) AS r, coalesce(n.g, o.g) AS g, coalesce(n.b, o.b) AS b, coalesce(n.a, o.a) AS a
  FROM f_raster o FULL JOIN (
    SELECT 0 AS raster_id, {_CX} AS px, {_CY} AS py, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b, arg_max(a, seq) AS a
    FROM (SELECT seq, (px * 3 - 100) AS px, (py * 2 - 40) AS py, b AS r, g, r AS b, 128::SMALLINT AS a FROM f_puts) GROUP BY 2, 3
  ) n USING (raster_id, px, py)""")
def _(t):
    late = t.puts.select(
        "raster_id", "seq", (F.col("px") * 3 - 100).alias("px"), (F.col("py") * 2 - 40).alias("py"),
        F.col("b").alias("r"), "g", F.col("r").alias("b"), F.lit(128).cast("smallint").alias("a"),
    )
    return R.raster_put(t.raster, late, W, H)


@query("raster_sample", f"""
  SELECT k.plate_id, k.kf_seq, k.point_idx, coalesce(r, 0)::SMALLINT AS r, coalesce(g, 0)::SMALLINT AS g, coalesce(b, 0)::SMALLINT AS b, coalesce(a, 0)::SMALLINT AS a,
         {r('coalesce(r, 0) / 256e0', 'age')}
  FROM (SELECT *, {_CX.replace('px', 'x')} AS px, {_CY.replace('py', 'y')} AS py
        FROM (SELECT *, floor(u * {2 * H}e0 + 0.5e0) AS x, floor((1e0 - v) * {H}e0 + 0.5e0) AS y FROM f_kf)) k
  LEFT JOIN f_raster USING (px, py)""")
def _(t):
    px, py = S.uv_to_pixel(F.col("u"), F.col("v"), H)
    points = t.keyframes.select(
        "plate_id", "kf_seq", "point_idx", F.lit(0).alias("raster_id"), px.alias("px"), py.alias("py")
    )
    out = R.raster_sample(points, t.raster, W, H).drop("raster_id", "px", "py")
    return rounded(out.withColumn("age", F.col("r") / 256.0), "age")


_AGES = [0.0, 0.1, 0.5, 0.98, 1.0]


@query("age_band_mask", f"""
  SELECT raster_id, age, px::INT AS px, py::INT AS py, (CASE WHEN hit THEN r ELSE 0 END)::SMALLINT AS r,
         (CASE WHEN hit THEN g ELSE 0 END)::SMALLINT AS g, (CASE WHEN hit THEN b ELSE 0 END)::SMALLINT AS b,
         (CASE WHEN hit THEN 255 ELSE 0 END)::SMALLINT AS a
  FROM (SELECT raster_id, age, px, py, age < 0.99e0 AND abs(hue - red) < 3 AS hit, {RAMP}
        FROM (SELECT i.raster_id, age, x AS px, y AS py, floor(age * 255e0 + 0.5e0) AS hue, coalesce(f.r, 0) AS red
              FROM (SELECT DISTINCT raster_id FROM f_raster) i,
                   (SELECT unnest(range({W + 8})) AS x), (SELECT unnest(range({H + 4})) AS y),
                   (SELECT unnest([{', '.join(f'{a}e0' for a in _AGES)}]) AS age)
              LEFT JOIN f_raster f ON f.px = least(x, {W - 1}) AND f.py = least(y, {H - 1}) AND f.raster_id = i.raster_id))""")
def _(t):
    # The output image is a little larger than the raster, whose edge then repeats.
    images = t.raster.select("raster_id").distinct().select(
        "raster_id", F.lit(W + 8).alias("w"), F.lit(H + 4).alias("h"), F.lit(0).alias("x0"), F.lit(0).alias("y0")
    )
    grid = G.gen_pixel_grid(images, "w", "h", "x0", "y0").select(
        "raster_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")
    )
    return R.age_band_mask(grid, t.raster, _AGES, W, H)


@query("raster_sample_tiles", ORACLE["raster_sample"])
def _(t):
    px, py = S.uv_to_pixel(F.col("u"), F.col("v"), H)
    points = t.keyframes.select(
        "plate_id", "kf_seq", "point_idx", F.lit(0).alias("raster_id"), px.alias("px"), py.alias("py")
    )
    out = TI.sample_tiles(points, TI.raster_tiles(t.raster, W, H), W, H).drop("raster_id", "px", "py")
    return rounded(out.withColumn("age", F.col("r") / 256.0), "age")


@query("age_band_mask_tiles", ORACLE["age_band_mask"])
def _(t):
    # The raster as an image file that the executors wrote.
    path = scratch_path(t.spark, "images")
    I.write_bitmaps(t.raster, path, W, H)
    named = F.regexp_extract("origin", "raster_id=([0-9]+)", 1).cast("int")
    tiles = TI.scan_tiles(t.spark, path).withColumn("raster_id", named)
    return TI.age_band_mask_tiles(tiles, _AGES, W, H, W + 8, H + 4)


_ZEROS, _ENTRIES = 77, 77 + 179  # the table for time 0.3


def _step(c: str) -> str:
    return f"(CASE WHEN least(floor({c} / 255e0 * {_ENTRIES}e0), {_ENTRIES - 1}) >= {_ZEROS} THEN 1e0 ELSE 0e0 END)"


@query("age_threshold_mask", f"""
  SELECT raster_id, px, py, (255 * {_step('r')})::SMALLINT AS r, (255 * {_step('g')})::SMALLINT AS g, (255 * {_step('b')})::SMALLINT AS b,
         floor(greatest(0e0, least(1e0, a / 255e0 * 0.5e0 - {_step('r')})) * 255e0 + 0.5e0)::SMALLINT AS a FROM f_raster""")
def _(t):
    return R.age_threshold_mask(t.raster, 0.3)


# --- generators ----------------------------------------------------------------


@query("gen_range", """
  SELECT p_partkey, seq, seq * step AS value
  FROM (SELECT p_partkey, p_size % 11 - 3 AS step, unnest(generate_series(0, p_size - 1)) AS seq FROM part) WHERE step > 0""")
def _(t):
    rows = t.part.select("p_partkey", "p_size", (F.col("p_size") % 11 - 3).alias("step"))
    return G.gen_range(rows, "p_size", "step").select("p_partkey", "seq", "value")


@query("gen_pixel_grid", """
  SELECT s_suppkey, px, py
  FROM (SELECT s_suppkey, s_suppkey % 9 AS w, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 9 ELSE s_suppkey % 7 END AS h, s_suppkey % 3 AS x0, s_suppkey % 2 AS y0 FROM supplier),
       LATERAL (SELECT unnest(range(x0, w)) AS px), LATERAL (SELECT unnest(range(y0, h)) AS py)""")
def _(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        "s_suppkey", (k % 9).alias("w"), F.when(k % 4 != 0, k % 7).alias("h"), (k % 3).alias("x0"), (k % 2).alias("y0")
    )
    return G.gen_pixel_grid(rows, "w", "h", "x0", "y0").select("s_suppkey", "px", "py")


@query("gen_equirect_uvs", f"""
  SELECT s_suppkey, 0 AS seq, 0.5e0 AS u, 0e0 AS v FROM supplier
  UNION ALL SELECT s_suppkey, (y - 1) * (2 * res - 1) + x, {r('x / (2e0 * res)', 'u')}, {r('y / res::DOUBLE', 'v')}
  FROM (SELECT s_suppkey, s_suppkey % 5 + 1 AS res FROM supplier),
       LATERAL (SELECT unnest(range(1, res)) AS y), LATERAL (SELECT unnest(range(1, 2 * res)) AS x)
  UNION ALL SELECT s_suppkey, (s_suppkey % 5) * (2 * (s_suppkey % 5) + 1) + 1, 0.5e0, 1e0 FROM supplier""")
def _(t):
    rows = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 5 + 1).alias("res"))
    return rounded(G.gen_equirect_uvs(rows, "res").drop("res"), "u", "v")


def _globes(t):
    return t.supplier.select(F.col("s_suppkey").alias("mesh_id"), (F.col("s_suppkey") % 6 + 1).alias("res"))


def _face_axis(name: str, x: str, y: str) -> str:
    fu, fv = f"({x} * (1e0 / res) - 0.5e0)", f"({y} * (1e0 / res) - 0.5e0)"
    cases = []
    for i, (u, v, w, du, dv, dw) in enumerate(G.CUBE_FACES):
        e = f"{fu} * {du}e0" if name == u else f"{fv} * {dv}e0" if name == v else f"{dw * 0.5}::DOUBLE"
        cases.append(f"WHEN {i} THEN {e}")
    return f"(CASE face {' '.join(cases)} END)"


def _quad_sql() -> str:
    """Quads with corner points and seam-fixed uvs, one subquery per step."""
    base = """SELECT s_suppkey AS mesh_id, res, face, qx, qy, ((face * res + qy) * res + qx) * 4 AS vertex_id
      FROM (SELECT s_suppkey, s_suppkey % 6 + 1 AS res FROM supplier), (SELECT unnest(range(6)) AS face),
           LATERAL (SELECT unnest(range(res)) AS qy), LATERAL (SELECT unnest(range(res)) AS qx)"""
    corners = list(enumerate(G.CORNER_STEPS))
    flat = f"SELECT *, " + ", ".join(
        f"{_face_axis(c, f'(qx + {dx})', f'(qy + {dy})')} AS f{k}{c}" for k, (dx, dy) in corners for c in "xyz"
    ) + f" FROM ({base})"
    bent = "SELECT *, " + ", ".join(
        f"f{k}{c} * sqrt(1 - f{k}{p} * f{k}{p} / 2 - f{k}{q} * f{k}{q} / 2 + f{k}{p} * f{k}{p} * f{k}{q} * f{k}{q} / 3) AS b{k}{c}"
        for k in range(4) for c, p, q in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))
    ) + f" FROM ({flat})"
    unit = "SELECT *, " + ", ".join(
        f"b{k}{c} / sqrt(b{k}x * b{k}x + b{k}y * b{k}y + b{k}z * b{k}z) AS p{k}{c}" for k in range(4) for c in "xyz"
    ) + f" FROM ({bent})"
    sql = "SELECT *, " + ", ".join(
        f"0.5e0 + atan2(p{k}x + 0e0, p{k}z + 0e0) / (2 * pi()) AS u{k}, 0.5e0 + asin(p{k}y) / pi() AS v{k}" for k in range(4)
    ) + f" FROM ({unit})"
    for k in range(4):
        rest = ", ".join(f"u{j}" for j in range(4) if j != k)
        sql = (
            f"SELECT * REPLACE (CASE WHEN u{k} = 0 AND greatest({rest}) > 0.5e0 THEN 1e0 "
            f"WHEN u{k} = 1 AND least({rest}) < 0.5e0 THEN 0e0 ELSE u{k} END AS u{k}) FROM ({sql})"
        )
    for k in range(4):
        rest = " + ".join(f"u{j}" for j in range(4) if j != k)
        sql = f"SELECT * REPLACE (CASE WHEN v{k} IN (0e0, 1e0) THEN ({rest}) / 3e0 ELSE u{k} END AS u{k}) FROM ({sql})"
    return sql


_QUADS = f"({_quad_sql()})"
_VERTEX = " UNION ALL ".join(
    f"SELECT mesh_id, face::INT AS face, vertex_id + {k} AS vertex_id, {r(f'p{k}x', 'x')}, {r(f'p{k}y', 'y')}, {r(f'p{k}z', 'z')}, "
    f"{r(f'u{k}', 'u')}, {r(f'v{k}', 'v')} FROM q" for k in range(4)
)


@query("gen_cube_sphere", f"WITH q AS {_QUADS} {_VERTEX}")
def _(t):
    return rounded(G.gen_cube_sphere(_globes(t), "res").drop("res"), "x", "y", "z", "u", "v")


@query("cube_to_sphere", f"""
  SELECT mesh_id, vertex_id // 4 AS quad_id, {', '.join(r(f'p{k}{c}', f'p{k}{c}') for k in range(4) for c in 'xyz')} FROM {_QUADS}""")
def _(t):
    quads = G.cube_to_sphere(G.gen_cube_quads(_globes(t), "res"), "res")
    names = [f"p{k}{c}" for k in range(4) for c in "xyz"]
    return rounded(quads.select("mesh_id", F.expr("vertex_id div 4").alias("quad_id"), *names), *names)


@query("fix_seam_uvs", f"""
  SELECT mesh_id, vertex_id // 4 AS quad_id, {', '.join(r(f'{c}{k}', f'{c}{k}') for k in range(4) for c in 'uv')} FROM {_QUADS}""")
def _(t):
    quads = G.fix_seam_uvs(G.quad_corner_points(G.gen_cube_quads(_globes(t), "res"), "res"))
    names = [f"{c}{k}" for k in range(4) for c in "uv"]
    return rounded(quads.select("mesh_id", F.expr("vertex_id div 4").alias("quad_id"), *names), *names)


@query("cube_sphere_indices", f"""
  SELECT mesh_id, vertex_id // 2 AS tri_id, vertex_id AS a, vertex_id + 2 AS b, vertex_id + 1 AS c FROM {_QUADS}
  UNION ALL SELECT mesh_id, vertex_id // 2 + 1, vertex_id + 1, vertex_id + 2, vertex_id + 3 FROM {_QUADS}""")
def _(t):
    return G.cube_sphere_triangles(G.gen_cube_quads(_globes(t), "res")).drop("res")


_QUAD_ANGLES = [angle("p1", "p0", "p2"), angle("p0", "p1", "p3"), angle("p0", "p2", "p3"), angle("p1", "p3", "p2")]


@query("quad_angles", f"""
  SELECT mesh_id, vertex_id // 4 AS quad_id, {', '.join(r(e, f'angle_{n}') for e, n in zip(_QUAD_ANGLES, 'abcd'))} FROM {_QUADS}""")
def _(t):
    quads = G.cube_to_sphere(G.gen_cube_quads(_globes(t), "res"), "res")
    names = [f"angle_{n}" for n in "abcd"]
    angles = S.quad_angles(*[S.vec(f"p{k}") for k in range(4)])
    out = quads.select("mesh_id", F.expr("vertex_id div 4").alias("quad_id"), *[a.alias(n) for a, n in zip(angles, names)])
    return rounded(out, *names)


def _area(a, b, c):
    return f"({angle(a, b, c)} + {angle(b, a, c)} + {angle(b, c, a)} - pi())"


@query("quad_area", f"""
  SELECT mesh_id, vertex_id // 4 AS quad_id, {r(_area('p0', 'p2', 'p1') + ' + ' + _area('p1', 'p2', 'p3'), 'area')} FROM {_QUADS}""")
def _(t):
    quads = G.cube_to_sphere(G.gen_cube_quads(_globes(t), "res"), "res")
    area = S.quad_area(*[S.vec(f"p{k}") for k in range(4)])
    return rounded(quads.select("mesh_id", F.expr("vertex_id div 4").alias("quad_id"), area.alias("area")), "area")


@query("gen_time_grid", f"""
  SELECT s_suppkey, frame, {r('time', 'time')}, {r('percent', 'percent')}, {r('280e0 * (percent / 100e0)', 'age')} FROM (
    SELECT s_suppkey, frame,
      CASE WHEN frame % (2 * n) <= n THEN least(least(1e0, n * step), (frame % (2 * n)) * step)
           ELSE greatest(0e0, least(1e0, n * step) - (frame % (2 * n) - n) * step) END AS time,
      CASE WHEN frame % (2 * m) <= m THEN least(100e0, 1e0 + (frame % (2 * m)) * rate)
           ELSE greatest(1e0, 100e0 - (frame % (2 * m) - m) * rate) END AS percent
    FROM (SELECT *, ceil(0.3e0 / step)::BIGINT AS n, floor(99e0 / rate)::BIGINT + 1 AS m
          FROM (SELECT s_suppkey, (s_suppkey % 40 + 10) * 0.0001e0 * 1 AS step, (s_suppkey % 6 + 1)::DOUBLE AS rate FROM supplier)),
         (SELECT unnest(range(400)) AS frame))""")
def _(t):
    rows = t.supplier.select(
        "s_suppkey", F.lit(400).alias("n"), (F.col("s_suppkey") % 40 + 10).cast("double").alias("ms"),
        (F.col("s_suppkey") % 6 + 1).alias("rate"),
    )
    out = G.gen_time_grid(rows, "n", "ms", "rate", 0.3).select("s_suppkey", "frame", "time", "percent", "age")
    return rounded(out, "time", "percent", "age")


# --- documents -----------------------------------------------------------------

_DOC_ROWS = f"""
  SELECT plate_id, dense_rank() OVER (PARTITION BY plate_id ORDER BY kf_seq) - 1 AS kf_seq, {r('time', 'time', 9)}, point_idx, {rs('u', 'v')} FROM f_kf
  UNION ALL SELECT plate_id, -1, 0e0, point_idx, {rs('u', 'v')} FROM f_base"""


def _document_rows(docs):
    base, keyframes = P.scan_plates_json(docs, "doc_id")
    zero = base.select("plate_id", F.lit(-1).cast("bigint").alias("kf_seq"), F.lit(0.0).alias("time"), "point_idx", "u", "v")
    out = keyframes.drop("doc_id").unionByName(zero)
    return rounded(rounded(out, "u", "v"), "time", digits=9)


@query("scan_plates_json", _DOC_ROWS)
def _(t):
    # As stored: beside every document one that was cut off while it was written.
    both = F.explode(F.array("doc", F.lit('[{"points": [')))
    stored = P.plates_to_json(t.base, t.keyframes).select(F.col("plate_id").alias("doc_id"), both.alias("doc"))
    return _document_rows(cut_lineage(stored))


@query("scan_plates_whole", f"""
  SELECT plate_id, -1 AS kf_seq, 0e0 AS time, CASE WHEN plate_id % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n FROM (SELECT DISTINCT plate_id FROM f_base)
  UNION ALL
  SELECT plate_id, dense_rank() OVER (PARTITION BY plate_id ORDER BY kf_seq) - 1, {r('time', 'time', 9)}, CASE WHEN kf_seq % 4 = 0 THEN 0 ELSE 2 END
  FROM (SELECT DISTINCT plate_id, kf_seq, time FROM f_kf)
  UNION ALL SELECT plate_id, -2, 0e0, 2 FROM (SELECT DISTINCT plate_id FROM f_base) WHERE plate_id % 3 = 0""")
def _(t):
    # Plates and frames without points, and documents that broke off or hold something else.
    plates, frames = t.base.select("plate_id").distinct(), t.keyframes.select("plate_id", "kf_seq", "time").distinct()
    docs = P.plates_to_json(t.base.where("plate_id % 5 <> 0"), t.keyframes.where("kf_seq % 4 <> 0"), plates=plates, frames=frames)
    broken = plates.where("plate_id % 3 = 0").select("plate_id", F.explode(F.array(F.lit('[{"points": ['), F.lit('[{"points": "none"}]'))).alias("doc"))
    read = P.scan_documents(cut_lineage(docs.select("plate_id", "doc").unionByName(broken).withColumnRenamed("plate_id", "doc_id")))
    count = F.count("point_idx").alias("n")
    base = read.plates.join(read.base, ["doc_id", "plate_id"], "left").groupBy("plate_id").agg(count).select(
        "plate_id", F.lit(-1).cast("long").alias("kf_seq"), F.lit(0.0).alias("time"), "n")
    points = read.keyframes.select("doc_id", "plate_id", "kf_seq", "point_idx")
    on_frames = read.frames.join(points, ["doc_id", "plate_id", "kf_seq"], "left").groupBy("plate_id", "kf_seq", "time").agg(count)
    bad = read.broken.groupBy(F.col("doc_id").alias("plate_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "plate_id", F.lit(-2).cast("long").alias("kf_seq"), F.lit(0.0).alias("time"), "n")
    return rounded(base.unionByName(on_frames).unionByName(bad), "time", digits=9)


@query("sink_plates_json", _DOC_ROWS)
def _(t):
    path = scratch_path(t.spark, "plates")
    P.sink_plates_json(t.base, t.keyframes, path)
    return _document_rows(t.spark.read.parquet(path).withColumnRenamed("plate_id", "doc_id"))


@query("snapshot_backup", _DOC_ROWS)
def _(t):
    path, backups = scratch_path(t.spark, "plates"), scratch_path(t.spark, "backups")
    P.sink_plates_json(t.base, t.keyframes, path)
    copy = P.snapshot_backup(t.spark, path, backups, "2024-01-01T00-00-00Z")
    return _document_rows(copy.withColumnRenamed("plate_id", "doc_id"))


_SCALED = "floor({}::FLOAT::DOUBLE * 10000e0 + 0.5e0)::BIGINT"


def _buffers(t):
    return P.geometry_flatten(_xyz(t.nodes), ["plate_id"], "node_id", ["x", "y", "z"])


@query("geometry_flatten", f"""
  SELECT plate_id, 0 AS part, string_agg({' || '.join(f"{_SCALED.format(c)} || ' '" for c in 'xyz')}, '' ORDER BY node_id) AS buffer
  FROM (SELECT *, {xyz('', 'u', 'v')} FROM f_nodes) GROUP BY plate_id""")
def _(t):
    text = F.transform("buffer", lambda c: F.concat(N.half_up(c.cast("double") * 10000.0).cast("string"), F.lit(" ")))
    return _buffers(t).select("plate_id", F.col("part").cast("int").alias("part"), F.array_join(text, "").alias("buffer"))


@query("geometry_unflatten", f"""
  SELECT plate_id, node_id AS seq, {r('x::FLOAT::DOUBLE', 'x', 5)}, {r('y::FLOAT::DOUBLE', 'y', 5)}, {r('z::FLOAT::DOUBLE', 'z', 5)}
  FROM (SELECT *, {xyz('', 'u', 'v')} FROM f_nodes)""")
def _(t):
    out = P.geometry_unflatten(_buffers(t), ["plate_id"], ["x", "y", "z"])
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in "xyz"}), "x", "y", "z", digits=5)
