"""Rasters as tiles against rasters as rows."""

import random

import pytest
from pyspark.sql import functions as F

from platefield.operators import raster as R
from platefield.operators import tiles as T
from platefield.operators.spread import spread
from platefield.sources import images as I

PIXELS = "raster_id int, px int, py int, r smallint, g smallint, b smallint, a smallint"


def _raster(spark, width, height, share, ids=(0, 1, None)):
    draw = random.Random(width * 1000 + height)
    rows = [
        (i, x, y, *(draw.randrange(256) for _ in "rgba"))
        for i in ids for x in range(width) for y in range(height) if draw.random() < share
    ]
    return spark.createDataFrame(rows, PIXELS)


def _rows(df):
    order = sorted(df.columns)
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width,height,side,share", [(7, 5, 4, 0.6), (8, 8, 4, 1.0), (1, 9, 4, 0.5), (5, 3, 32, 0.1), (6, 6, 1, 0.5)])
@pytest.mark.parametrize("wrap", [False, True])
def test_samples_of_tiles_equal_samples_of_rows(spark, width, height, side, share, wrap):
    raster = _raster(spark, width, height, share)
    draw = random.Random(5)
    points = [(draw.choice([0, 1, 2, None]), draw.randrange(-20, 30), draw.randrange(-9, 20), k) for k in range(400)]
    # A hot pixel, and rows that are equal in all columns.
    points += [(0, 3, 2, 7)] * 300 + [(0, None, 2, 8), (0, 1, None, 9)]
    points = spark.createDataFrame(points, "raster_id int, px int, py int, k int")
    tiles = T.raster_tiles(raster, width, height, side)
    got = T.sample_tiles(points, tiles, width, height, wrap, side, share=8)
    assert got.columns == R.raster_sample(points, raster, width, height, wrap).columns
    assert _rows(got) == _rows(R.raster_sample(points, raster, width, height, wrap))


@pytest.mark.parametrize("out", [(7, 5), (12, 9), (4, 2)])
def test_masks_of_tiles_equal_masks_of_rows(spark, out):
    raster = _raster(spark, 7, 5, 0.7, ids=(0, 1))
    grid = raster.select("raster_id").distinct().withColumn("px", F.explode(F.expr(f"sequence(0, {out[0] - 1})")))
    grid = grid.withColumn("py", F.explode(F.expr(f"sequence(0, {out[1] - 1})")))
    ages = [0.1, 0.5, 1.0]
    want = R.age_band_mask(grid, raster, ages, 7, 5)
    # A raster may lack a tile as a whole.
    sparse = raster.where("px < 4 or raster_id = 0")
    for rows in (raster, sparse):
        want = R.age_band_mask(grid, rows, ages, 7, 5)
        got = T.age_band_mask_tiles(T.raster_tiles(rows, 7, 5, 4), ages, 7, 5, *out, side=4)
        assert _rows(got) == _rows(want)


def test_tiles_of_image_files(spark, tmp_path):
    raster = _raster(spark, 7, 5, 0.7, ids=(0, 1))
    I.write_bitmaps(raster, str(tmp_path / "images"), 7, 5)
    tiles = T.scan_tiles(spark, str(tmp_path / "images"), 4)
    assert {(r.width, r.height, r.channels) for r in tiles.collect()} == {(7, 5, 3)}
    assert tiles.agg(F.sum(F.length("pixels"))).first()[0] == 2 * 7 * 5 * 3
    named = tiles.withColumn("raster_id", F.regexp_extract("origin", "raster_id=([0-9]+)", 1).cast("int"))
    got = {(r.raster_id, r.px, r.py): (r.r, r.g, r.b, r.a) for r in T.tile_pixels(named, 7, 5, 7, 5, 4).collect()}
    have = {(r.raster_id, r.px, r.py): (r.r, r.g, r.b, 255) for r in raster.collect()}
    assert got == {k: have.get(k, (0, 0, 0, 255)) for k in got} and len(got) == 70


def test_odd_pixels_and_no_pixels(spark):
    rows = [(0, 1, 1, 5, None, 300, 9), (0, 1, 1, 4, 0, 0, 255), (0, -1, 0, 1, 1, 1, 1), (0, 3, 0, 1, 1, 1, 1), (0, None, 0, 1, 1, 1, 1)]
    tiles = T.raster_tiles(spark.createDataFrame(rows, PIXELS), 3, 2, 2)
    got = {(r.px, r.py): (r.r, r.g, r.b, r.a) for r in T.tile_pixels(tiles, 3, 2, 3, 2, 2).collect()}
    # The greatest of repeated pixels: blue leads, and is held within a byte.
    assert got == {(x, y): (5, 0, 255, 9) if (x, y) == (1, 1) else (0, 0, 0, 0) for x in range(3) for y in range(2)}
    nothing = T.raster_tiles(spark.createDataFrame([], PIXELS), 3, 2, 2)
    assert nothing.count() == 0 and T.tile_pixels(nothing, 3, 2, 3, 2, 2).count() == 0
    points = spark.createDataFrame([], "raster_id int, px int, py int")
    assert T.sample_tiles(points, tiles, 3, 2, side=2).count() == 0


def test_no_key_holds_more_than_its_share(spark):
    points = spark.range(20_000).select(
        F.lit(0).alias("raster_id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 50).cast("int")).alias("_tx"), F.lit(0).alias("_ty")
    )
    dealt, heavy = spread(points, ["raster_id", "_tx", "_ty"], 100)
    assert 0 < heavy.count() < 100
    most = dealt.groupBy("_tx", "_ty", "_part").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 20_000 / 100 and dealt.count() == 20_000
