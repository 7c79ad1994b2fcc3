"""Golden projections, colours, rasters and generators."""

import math

import pytest
from pyspark.sql import functions as F

from platefield.functions import color as C
from platefield.functions import numeric as N
from platefield.functions import sphere as S
from platefield.operators import generate as G
from platefield.operators import raster as R

GOLDEN = [(0.5, 0.0, 0, -1, 0), (0.5, 0.5, 0, 0, 1), (0.6, 0.7, 0.475, 0.587, 0.654)]


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("u,v,x,y,z", GOLDEN)
def test_uv_to_point(spark, u, v, x, y, z):
    row = _one(spark, **dict(zip("xyz", S.uv_to_xyz(F.lit(u), F.lit(v)))))
    assert (row.x, row.y, row.z) == pytest.approx((x, y, z), abs=0.005)


@pytest.mark.parametrize("u,v,x,y,z", [*GOLDEN, (0.5, 1.0, 0, 1, 0)])
def test_point_to_uv(spark, u, v, x, y, z):
    p = tuple(F.lit(float(c)) for c in (x, y, z))
    row = _one(spark, **dict(zip("uv", S.xyz_to_uv(p))))
    assert (row.u, row.v) == pytest.approx((u, v), abs=0.005)


@pytest.mark.parametrize("u,v", [(0.5, 0.5), (0.6, 0.7)])
def test_sphere_round_trip(spark, u, v):
    row = _one(spark, **dict(zip("uv", S.xyz_to_uv(S.uv_to_xyz(F.lit(u), F.lit(v))))))
    assert (row.u, row.v) == (u, v)


@pytest.mark.parametrize("u,v", [(0.5, 0.5), (0.4, 0.7), (0.6, 0.7)])
def test_pixel_round_trip(spark, u, v):
    px, py = S.uv_to_pixel(F.lit(u), F.lit(v), 400)
    row = _one(spark, **dict(zip("uv", S.pixel_to_uv(px, py, 400))))
    assert (row.u, row.v) == (u, v)


@pytest.mark.parametrize("fraction,y", [(0.0, 1.0), (1.0, 0.5)])
def test_intermediate_point(spark, fraction, y):
    row = _one(spark, y=S.lerp(F.lit(1.0), F.lit(0.5), F.lit(fraction)))
    assert row.y == y


def test_negative_u_shifts_once(spark):
    a = _one(spark, **dict(zip("xyz", S.uv_to_xyz(F.lit(-0.25), F.lit(0.3)))))
    b = _one(spark, **dict(zip("xyz", S.uv_to_xyz(F.lit(0.75), F.lit(0.3)))))
    assert a == b


def test_octant_area_and_flat_angle(spark):
    x, y, z = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    lit = lambda p: tuple(F.lit(c) for c in p)
    row = _one(spark, area=S.triangle_area(lit(x), lit(y), lit(z)), flat=S.angle(lit(x), lit(x), lit(y)))
    assert row.area == pytest.approx(math.pi / 2)
    assert row.flat is None


def test_numbers(spark):
    nan = F.lit(float("nan"))
    row = _one(
        spark,
        down=N.half_up(F.lit(-2.5)), up=N.half_up(F.lit(2.5)),
        nan=N.clamp01(nan), valid=N.clamp_input(nan, 3.0, 9.0), high=N.clamp01(F.lit(7.0)),
        z0=N.clz32(F.lit(0)), z1=N.clz32(F.lit(1)), z8=N.clz32(F.lit(8)), zm=N.clz32(F.lit(-1)),
        i1=N.imul(F.lit(0xFFFFFFFF), F.lit(5)), i2=N.imul(F.lit(0xFFFFFFFE), F.lit(5)), i3=N.imul(F.lit(123456789), F.lit(987654321)),
        t=N.trunc(F.lit(-2.7)),
    )
    assert (row.down, row.up, row.high, row.valid) == (-2, 3, 1.0, 3.0) and math.isnan(row.nan)
    assert (row.z0, row.z1, row.z8, row.zm) == (32, 31, 28, 0)
    wrapped = (123456789 * 987654321) & 0xFFFFFFFF
    assert (row.i1, row.i2, row.i3) == (-5, -10, wrapped - (1 << 32) if wrapped >> 31 else wrapped)
    assert row.t == -2.0


def test_colours(spark):
    hue = F.lit(30)
    red, green, blue = C.hue_to_rgb(hue)
    row = _one(
        spark, hex=C.hex_color(F.lit(1), F.lit(171), F.lit(255)), r=red, g=green, b=blue,
        short=C.age_label(F.lit(0.02)), long=C.age_label(F.lit(40.0)),
    )
    assert (row.hex, row.r, row.g, row.b) == ("#01abff", 255, 128, 0)
    assert (row.short, row.long) == ("  6", "11200")


def _raster(spark, rows):
    return spark.createDataFrame(rows, "raster_id int, px int, py int, r smallint, g smallint, b smallint, a smallint")


def test_raster_edges_and_last_write(spark):
    base = _raster(spark, [(0, 0, 0, 1, 2, 3, 255)])
    puts = spark.createDataFrame(
        [(0, 1, -5, 0, 9, 9, 9, 9), (0, 2, 0, -1, 7, 7, 7, 7), (0, 3, 99, 99, 5, 5, 5, 5)],
        "raster_id int, seq bigint, px int, py int, r smallint, g smallint, b smallint, a smallint",
    )
    done = R.raster_put(base, puts, 4, 3)
    assert {(r.px, r.py): r.r for r in done.collect()} == {(0, 0): 7, (3, 2): 5}
    points = spark.createDataFrame([(0, -9, 0), (0, 50, 50), (0, 1, 1)], "raster_id int, px int, py int")
    got = {(r.px, r.py): (r.r, r.a) for r in R.raster_sample(points, done, 4, 3).collect()}
    assert got == {(-9, 0): (7, 7), (50, 50): (5, 5), (1, 1): (0, 0)}
    around = {(r.px, r.py): r.r for r in R.raster_sample(points, done, 4, 3, wrap=True).collect()}
    assert around == {(-9, 0): 0, (50, 50): 0, (1, 1): 0}
    assert R.raster_sample(points.where("px < 0").withColumn("px", F.lit(-4)), done, 4, 3, wrap=True).first().r == 7


@pytest.mark.parametrize("new", [(7, 5), (2, 2), (4, 3), (1, 1)])
def test_resize_takes_the_pixel_under_the_centre(spark, new):
    w, h = 4, 3
    raster = _raster(spark, [(0, x, y, 10 * x + y, 0, 0, 0) for x in range(w) for y in range(h)])
    got = {(r.px, r.py): r.r for r in R.resize_nearest(raster, w, h, *new).collect()}
    want = {
        (x, y): 10 * int((x + 0.5) * w / new[0]) + int((y + 0.5) * h / new[1])
        for x in range(new[0]) for y in range(new[1])
    }
    assert got == want


def test_threshold_hides_what_is_bright(spark):
    raster = _raster(spark, [(0, 0, 0, 10, 0, 0, 255), (0, 1, 0, 250, 0, 0, 255), (0, 2, 0, 10, 0, 0, 100)])
    got = {r.px: (r.r, r.a) for r in R.age_threshold_mask(raster, 0.5).collect()}
    assert got == {0: (0, 128), 1: (255, 0), 2: (0, 50)}


def test_generators(spark):
    one = spark.range(1)
    rows = G.gen_range(one.select(F.lit(4).alias("n"), F.lit(3).alias("step")), "n", "step")
    assert [r.value for r in rows.orderBy("seq").collect()] == [0, 3, 6, 9]
    assert G.gen_range(one.select(F.lit(4).alias("n"), F.lit(-3).alias("step")), "n", "step").count() == 0
    assert G.gen_range(one.select(F.lit(0).alias("n"), F.lit(1).alias("step")), "n", "step").count() == 0
    uvs = G.gen_equirect_uvs(one.select(F.lit(16).alias("res")), "res")
    assert uvs.count() == 2 + 15 * 31
    assert [r.seq for r in uvs.orderBy("seq").collect()] == list(range(2 + 15 * 31))
    sphere = G.gen_cube_sphere(one.select(F.lit(20).alias("res")), "res").cache()
    assert sphere.count() == 9600 and sphere.select("vertex_id").distinct().count() == 9600
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    assert sphere.where(F.abs(length - 1) > 1e-12).count() == 0
    spread = sphere.groupBy(F.expr("vertex_id div 4")).agg((F.max("u") - F.min("u")).alias("du"))
    assert spread.where("du > 0.5").count() == 0
    quads = G.gen_cube_quads(one.select(F.lit(20).alias("res")), "res")
    assert G.cube_sphere_triangles(quads).count() == 4800


def test_broken_resolution_fails(spark):
    with pytest.raises(Exception, match="integer"):
        G.gen_cube_sphere(spark.range(1).select(F.lit(2.5).alias("res")), "res").collect()


def test_clock_clamps_and_turns(spark):
    rows = spark.range(1).select(F.lit(12).alias("n"), F.lit(3000.0).alias("ms"), F.lit(40).alias("rate"))
    got = G.gen_time_grid(rows, "n", "ms", "rate").orderBy("frame").collect()
    time, percent, up, rising, t, p = [], [], True, True, 0.0, 1.0
    for _ in range(12):
        time.append(t)
        percent.append(p)
        t = max(0.0, min(1.0, t + (0.3 if up else -0.3)))
        up = False if t >= 1 else True if t <= 0 else up
        p += 40 if rising else -40
        if p > 100:
            rising, p = False, 100.0
        if p < 1:
            rising, p = True, 1.0
    assert [r.time for r in got] == pytest.approx(time)
    assert [r.percent for r in got] == percent
