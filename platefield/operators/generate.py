"""Row generators. Each takes a table of parameters and gives each row its own sequence.

A row first expands to lines (or blocks of BLOCK numbers), these are dealt over the
cluster, and then each one expands to cells: no single row builds an array of a whole
image, and one row of a large image is the work of all executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..functions.numeric import clamp01

# The six cube faces as axes (u, v, w) and their directions.
CUBE_FACES = [
    ("z", "y", "x", -1, -1, 1),
    ("z", "y", "x", 1, -1, -1),
    ("x", "z", "y", 1, 1, 1),
    ("x", "z", "y", 1, -1, -1),
    ("x", "y", "z", 1, -1, 1),
    ("x", "y", "z", -1, -1, -1),
]


BLOCK = 65536


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows over as many tasks as the cluster runs at once, or more; adaptive execution leaves a given number alone."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)


def numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row with ``name`` = 0 .. n-1, in blocks that are dealt out."""
    blocks = df.withColumn("_n", n.cast("bigint")).withColumn("_b", F.explode(counted(F.ceil(F.col("_n") / BLOCK))))
    first = F.col("_b") * BLOCK
    own = F.explode(F.sequence(first, F.least(first + BLOCK, F.col("_n")) - 1))
    return spread(blocks, "_b", *df.columns).withColumn(name, own).drop("_n", "_b")


def counted(n: Column) -> Column:
    """0 .. n-1; NULL (no rows under explode) when n <= 0, where ``sequence`` would descend."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))


def gen_range(df: DataFrame, size: str, step: str) -> DataFrame:
    """Each row with 0, step, 2*step, ... ``size`` times; a step that is not positive gives nothing."""
    rows = numbered(df, F.when(F.col(step) > 0, F.col(size)), "seq")
    return rows.withColumn("value", F.col("seq") * F.col(step))


def gen_pixel_grid(df: DataFrame, width: str, height: str, start_x: str, start_y: str) -> DataFrame:
    """Pixels of each row's rectangle; a missing width or height takes the other one."""
    w = F.coalesce(width, height, F.lit(0))
    h = F.coalesce(height, width, F.lit(0))
    x0, y0 = F.coalesce(start_x, F.lit(0)), F.coalesce(start_y, F.lit(0))
    lines = df.withColumns({"_w": w - x0, "_x": x0, "_y": y0}).withColumn("py", F.explode(counted(h - y0)))
    return (
        spread(lines, "py", *df.columns)
        .withColumn("px", F.explode(counted(F.col("_w"))))
        .withColumns({"px": F.col("px") + F.col("_x"), "py": F.col("py") + F.col("_y")})
        .drop("_w", "_x", "_y")
    )


def gen_equirect_uvs(df: DataFrame, resolution: str) -> DataFrame:
    """South pole, inner lattice in row-major order, north pole; ``seq`` counts from 0."""
    res = F.col(resolution).cast("bigint")
    lines = df.withColumn("_y", F.explode(counted(res + 1)))
    pole = (F.col("_y") == 0) | (F.col("_y") == res)
    cells = spread(lines, "_y", *df.columns).withColumn("_x", F.explode(counted(F.when(pole, F.lit(1)).otherwise(res * 2 - 1))))
    inner = (F.col("_y") - 1) * (res * 2 - 1) + F.col("_x") + 1
    seq = F.when(F.col("_y") == 0, F.lit(0)).when(F.col("_y") == res, (res - 1) * (res * 2 - 1) + 1)
    return cells.select(
        *df.columns,
        seq.otherwise(inner).alias("seq"),
        F.when(pole, F.lit(0.5)).otherwise((F.col("_x") + 1) / res / F.lit(2.0)).alias("u"),
        F.when(F.col("_y") == 0, F.lit(0.0)).otherwise(F.col("_y") / res).alias("v"),
    )


def _face_table() -> Column:
    """The faces as structs: each axis as weights of the two plane directions and of the half size."""
    faces = []
    for i, (u, v, w, du, dv, dw) in enumerate(CUBE_FACES):
        weights = [F.lit(i).alias("face")]
        for axis in "xyz":
            for name, own, direction in (("u", u, du), ("v", v, dv), ("w", w, dw)):
                weights.append(F.lit(float(direction) if own == axis else 0.0).alias(f"{axis}{name}"))
        faces.append(F.struct(*weights))
    return F.array(*faces)


def gen_cube_quads(df: DataFrame, resolution: str) -> DataFrame:
    """One row per quad of a subdivided cube: ``face_axes, qx, qy`` and its first ``vertex_id``."""
    res = F.col(resolution).cast("bigint")
    lines = (
        df.where(F.when(F.floor(F.col(resolution)) == F.col(resolution), F.lit(True)).otherwise(
            F.raise_error(F.lit("resolution must be an integer")).cast("boolean")))
        .withColumn("face_axes", F.explode(_face_table()))
        .withColumn("_face", F.col("face_axes.face"))
        .withColumn("qy", F.explode(counted(res)))
    )
    return (
        spread(lines, "_face", "qy", *df.columns)
        .drop("_face")
        .withColumn("qx", F.explode(counted(res)))
        .withColumn("vertex_id", ((F.col("face_axes.face") * res + F.col("qy")) * res + F.col("qx")) * 4)
    )


CORNER_STEPS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def cube_to_sphere(quads: DataFrame, resolution: str, size: float = 1.0) -> DataFrame:
    """Adds ``p<k>x, p<k>y, p<k>z``: the four corners of each quad, mapped to the unit sphere.

    One projection per step keeps every expression small and computed once.
    """
    half = size / 2.0
    axes = [(k, c) for k in range(4) for c in "xyz"]
    line = F.lit(float(size)) / F.col(resolution)
    out = quads.withColumns(
        {f"_{q}{d}": (F.col(f"q{q}") + float(d)) * line - half for q in "xy" for d in (0, 1)}
    )
    flat, squares, bent, unit = {}, {}, {}, {}
    for k, c in axes:
        dx, dy = CORNER_STEPS[k]
        weight = lambda w: F.col(f"face_axes.{c}{w}")
        flat[f"_f{k}{c}"] = F.col(f"_x{dx}") * weight("u") + F.col(f"_y{dy}") * weight("v") + weight("w") * half
        squares[f"_s{k}{c}"] = F.col(f"_f{k}{c}") * F.col(f"_f{k}{c}")
        p, q = (F.col(f"_s{k}{o}") for o in "xyz" if o != c)
        bent[f"_b{k}{c}"] = F.col(f"_f{k}{c}") * F.sqrt(F.lit(1.0) - p / 2.0 - q / 2.0 + (p * q) / 3.0)
        unit[f"p{k}{c}"] = F.try_divide(F.col(f"_b{k}{c}"), F.col(f"_l{k}"))
    lengths = {f"_l{k}": S.length(S.vec(f"_b{k}")) for k in range(4)}
    for step in (flat, squares, bent, lengths, unit):
        out = out.withColumns(step)
    return out.select(*quads.columns, *unit)


def quad_corner_points(quads: DataFrame, resolution: str, size: float = 1.0) -> DataFrame:
    """Adds the corner points and their ``u<k>, v<k>``."""
    uvs = {}
    for k in range(4):
        u, v = S.xyz_to_uv(S.vec(f"p{k}"))
        uvs.update({f"u{k}": u, f"v{k}": v})
    return cube_to_sphere(quads, resolution, size).withColumns(uvs)


def fix_seam_uvs(quads: DataFrame) -> DataFrame:
    """Make the four corners of a quad agree on one side of the seam.

    Corner after corner, each seeing what the earlier ones became: u = 0 turns into
    1 beside a u above 0.5, u = 1 into 0 beside a u below 0.5; then a corner on a
    pole takes the mean of the other three.
    """
    others = lambda k: [F.col(f"u{j}") for j in range(4) if j != k]
    for k in range(4):
        u = F.col(f"u{k}")
        fixed = F.when((u == 0) & (F.greatest(*others(k)) > 0.5), F.lit(1.0)).when(
            (u == 1) & (F.least(*others(k)) < 0.5), F.lit(0.0)
        )
        quads = quads.withColumn(f"u{k}", fixed.otherwise(u))
    for k in range(4):
        a, b, c = others(k)
        at_pole = F.col(f"v{k}").isin(0.0, 1.0)
        quads = quads.withColumn(f"u{k}", F.when(at_pole, (a + b + c) / 3.0).otherwise(F.col(f"u{k}")))
    return quads


def gen_cube_sphere(df: DataFrame, resolution: str, size: float = 1.0) -> DataFrame:
    """Vertices of the subdivided cube on the sphere: position (also its normal) and uv."""
    quads = fix_seam_uvs(quad_corner_points(gen_cube_quads(df, resolution), resolution, size))
    corners = F.array(
        *[
            F.struct(
                F.col(f"p{k}x").alias("x"), F.col(f"p{k}y").alias("y"), F.col(f"p{k}z").alias("z"),
                F.col(f"u{k}").alias("u"), F.col(f"v{k}").alias("v"),
            )
            for k in range(4)
        ]
    )
    return quads.select(
        *df.columns, F.col("face_axes.face").alias("face"), "vertex_id", F.posexplode(corners).alias("k", "c")
    ).select(
        *df.columns, "face", (F.col("vertex_id") + F.col("k")).alias("vertex_id"),
        "c.x", "c.y", "c.z", "c.u", "c.v",
    )


def cube_sphere_triangles(quads: DataFrame) -> DataFrame:
    """Two triangles per quad: corners (0, 2, 1) and (1, 2, 3)."""
    at = F.col("vertex_id")
    halves = F.array(
        F.struct(at.alias("a"), (at + 2).alias("b"), (at + 1).alias("c")),
        F.struct((at + 1).alias("a"), (at + 2).alias("b"), (at + 3).alias("c")),
    )
    keep = [c for c in quads.columns if c not in ("face_axes", "qx", "qy", "vertex_id")]
    return quads.select(*keep, "vertex_id", F.posexplode(halves).alias("k", "t")).select(
        *keep, F.expr("vertex_id div 2 + k").alias("tri_id"), "t.a", "t.b", "t.c"
    )


def ping_pong(frame: Column, low: Column, high: Column, step: Column, turns: Column) -> Column:
    """Up from ``low`` by ``step`` per frame, turning after ``turns`` frames, and down again.

    The value is clamped at the turning points, not reflected.
    """
    at = F.pmod(frame, turns * 2).cast("double")
    up = F.least(high, low + at * step)
    down = F.greatest(low, high - (at - turns) * step)
    return F.when(at <= turns, up).otherwise(down)


def gen_time_grid(df: DataFrame, frames: str, millis: str, rate: str, end: float = 1.0) -> DataFrame:
    """Sampling times per row: the state of two clocks after each of ``frames`` frames.

    ``time`` moves by 0.0001 per millisecond and turns once it reaches ``end`` (it
    may overshoot by part of a step, up to 1) or 0. ``percent`` moves by ``rate``
    and turns once it passes 100 or 1. ``age`` maps the percentage onto 0..280.
    """
    rows = numbered(df, F.col(frames), "frame")
    step = F.col(millis) * 0.0001
    turns = F.ceil(F.lit(float(end)) / step)
    top = F.least(F.lit(1.0), turns * step)
    pace = F.col(rate).cast("double")
    percent_turns = F.floor(F.lit(99.0) / pace) + 1
    return rows.withColumns(
        {
            "time": clamp01(ping_pong(F.col("frame"), F.lit(0.0), top, step, turns)),
            "percent": ping_pong(F.col("frame"), F.lit(1.0), F.lit(100.0), pace, percent_turns),
        }
    ).withColumn("age", linear_age(F.lit(0.0), F.lit(280.0), F.col("percent")))


def linear_age(scale_a: Column, scale_b: Column, percent: Column) -> Column:
    return scale_a + (scale_b - scale_a) * (percent / 100.0)
