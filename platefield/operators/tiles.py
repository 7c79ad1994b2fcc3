"""Rasters as square tiles of bytes ``(raster_id, tx, ty, channels, pixels)``.

``pixels`` holds the lines of a tile from the top, each from the left, ``channels`` bytes per
pixel: blue, green, red and, of four, alpha, as Spark's image source has them; one channel is grey. Tiles at the right and
the bottom edge are as small as what is left of the raster. A tile that isn't there is transparent black.

What moves through an exchange is a tile and not a row per pixel: a raster of 8000 x 4000 is 31,250
tiles of 4 KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clamp_int
from .generate import counted
from .raster import CHANNELS, band_frames, clamp_pixel
from .spread import SHARE, copied, spread

#: Pixels along the side of a tile.
SIDE = 32


def _extent(tile: Column, side: int, length: int | Column) -> Column:
    """Pixels of a tile along one axis."""
    return F.least(F.lit(side), length - tile * side)


def _offset(px: Column, py: Column, side: int, width: int | Column) -> Column:
    """The place of a pixel in its tile."""
    stride = _extent(F.floor(px / side), side, F.lit(width))
    return (py % side) * stride + px % side


def _colours(pixel: Column, channels: Column) -> dict[str, Column]:
    """The channels of one pixel's bytes; without alpha it is opaque, without bytes transparent black."""
    value = F.conv(F.hex(pixel), 16, 10).cast("long")
    byte = lambda k: F.shiftright(value, 8 * k).bitwiseAND(255)
    # Counted from the last byte: of three channels red is the last one, of four it is alpha.
    opaque = channels < 4
    colour = lambda k: F.when(channels == 1, value).when(opaque, byte(k)).otherwise(byte(k + 1))
    of = {"r": colour(0), "g": colour(1), "b": colour(2), "a": F.when(opaque, F.lit(255)).otherwise(byte(0))}
    return {c: F.when(pixel.isNull(), F.lit(0)).otherwise(of[c]).cast("smallint") for c in CHANNELS}


def raster_tiles(raster: DataFrame, width: int, height: int, side: int = SIDE) -> DataFrame:
    """Tiles of ``raster(raster_id, px, py, r, g, b, a)`` with four channels.

    Pixels outside the raster are left out and those that lack are transparent black; of repeated pixels the
    one of the greatest colour counts, and NULL channels are 0. A task holds a tile, whatever the raster's size.
    """
    byte = lambda c: clamp_int(F.coalesce(F.col(c), F.lit(0)), 0, 255).cast("long")
    code = F.lit(0).cast("long")
    for c in ("b", "g", "r", "a"):
        code = code * 256 + byte(c)
    x, y = F.col("px"), F.col("py")
    placed = raster.where((x >= 0) & (x < width) & (y >= 0) & (y < height)).select(
        "raster_id", F.floor(x / side).cast("int").alias("tx"), F.floor(y / side).cast("int").alias("ty"),
        F.struct(_offset(x, y, side, width).cast("int").alias("at"), F.lpad(F.hex(code), 8, "0").alias("code")).alias("p"),
    )
    tiles = placed.groupBy("raster_id", "tx", "ty").agg(F.array_sort(F.collect_list("p")).alias("all"))
    p = F.filter("all", lambda e, i: (i == F.size("all") - 1) | (F.get("all", i + 1)["at"] != e["at"]))
    tiles = tiles.select("raster_id", "tx", "ty", p.alias("p"))
    # Each pixel behind the empty ones before it.
    gap = lambda e, i: e["at"] - F.coalesce(F.get("p", i - 1)["at"], F.lit(-1)) - 1
    filled = F.array_join(F.transform("p", lambda e, i: F.concat(F.repeat(F.lit("00000000"), gap(e, i)), e["code"])), "")
    area = _extent(F.col("tx"), side, F.lit(width)) * _extent(F.col("ty"), side, F.lit(height))
    return tiles.select(
        "raster_id", "tx", "ty", F.lit(4).alias("channels"), F.unhex(F.rpad(filled, 8 * area, F.lit("0"))).alias("pixels")
    )


def scan_tiles(spark: SparkSession, path: str, side: int = SIDE) -> DataFrame:
    """Tiles of every image file below ``path``, with its ``origin``, ``width`` and ``height``.

    The bytes of a tile are cut out of those of the image, line by line; no row per pixel is made.
    Files that are no images are skipped; no files give no tiles.
    """
    images = (
        spark.read.format("image").option("dropInvalid", True).load(path)
        .select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    )
    rows = images.withColumn("ty", F.explode(counted(F.ceil(F.col("height") / side))))
    # One band of lines goes on to the tiles of that band.
    bands = rows.withColumn("data", F.expr(f"substring(data, int(ty) * {side} * width * channels + 1, {side} * width * channels)"))
    tiles = bands.withColumn("tx", F.explode(counted(F.ceil(F.col("width") / side))))
    lines = [
        F.expr(f"substring(data, ({k} * width + int(tx) * {side}) * channels + 1, least({side}, width - int(tx) * {side}) * channels)")
        for k in range(side)
    ]
    return tiles.select(
        "origin", "width", "height", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "channels",
        F.concat(*lines).alias("pixels"),
    )


def sample_tiles(
    points: DataFrame, tiles: DataFrame, width: int, height: int, wrap: bool = False, side: int = SIDE, share: int = SHARE
) -> DataFrame:
    """Colour under each row of ``points(raster_id, px, py, ...)``, as :func:`.raster.raster_sample` gives it.

    Points meet their tile, of which a heavy one is there once per part of its points, and read their
    bytes by place. Points without a raster get transparent black.
    """
    px = F.pmod(F.col("px"), F.lit(width)) if wrap else F.col("px")
    x, y = clamp_pixel(px, F.col("py"), width, height)
    placed = points.withColumns({"_x": x, "_y": y}).withColumns(
        {"_tx": F.floor(F.col("_x") / side).cast("int"), "_ty": F.floor(F.col("_y") / side).cast("int")}
    )
    key = ["raster_id", "_tx", "_ty"]
    dealt, heavy = spread(placed, key, share)
    found = tiles.select("raster_id", F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("channels").alias("_channels"), F.col("pixels").alias("_pixels"))
    copies = copied(found, key, heavy)
    at = _offset(F.col("_x"), F.col("_y"), side, width) * F.col("_channels") + 1
    pixel = F.substring("_pixels", at.cast("int"), F.col("_channels"))
    joined = dealt.join(copies, [*key, "_part"], "left").withColumn("_pixel", pixel)
    return joined.withColumns(_colours(F.col("_pixel"), F.col("_channels"))).drop(
        "_x", "_y", "_tx", "_ty", "_part", "_channels", "_pixels", "_pixel"
    )


def tile_pixels(
    tiles: DataFrame, width: int, height: int, out_width: int, out_height: int, side: int = SIDE
) -> DataFrame:
    """Every pixel of the ``out_width`` x ``out_height`` image of each raster, whose edge repeats if it is smaller.

    Only tiles move: those that lack are added first, then each writes out its own pixels, and one
    at the edge also those beyond.
    """
    across, down = -(-width // side), -(-height // side)
    ids = tiles.select("raster_id").distinct()
    every = ids.withColumn("ty", F.explode(counted(F.lit(down)))).withColumn("tx", F.explode(counted(F.lit(across))))
    every = every.withColumns({c: F.col(c).cast("int") for c in ("tx", "ty")})
    whole = every.join(tiles.select("raster_id", "tx", "ty", "channels", "pixels"), ["raster_id", "tx", "ty"], "left")

    def span(tile: str, tiles_there: int, out: int) -> Column:
        first, behind = F.col(tile) * side, (F.col(tile) + 1) * side
        last = F.when(F.col(tile) == tiles_there - 1, F.lit(out)).otherwise(F.least(behind, F.lit(out))) - 1
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    stride = _extent(F.col("tx"), side, F.lit(width)) * F.col("channels")
    line = F.substring("pixels", (F.least("py", F.lit(height - 1)) % side * stride + 1).cast("int"), stride.cast("int"))
    lines = whole.withColumn("py", span("ty", down, out_height)).withColumn("line", line).drop("pixels")
    pixel = F.substring("line", (F.least("px", F.lit(width - 1)) % side * F.col("channels") + 1).cast("int"), F.col("channels"))
    pixels = lines.withColumn("px", span("tx", across, out_width)).withColumn("_pixel", pixel)
    return pixels.select("raster_id", "px", "py", *[v.alias(c) for c, v in _colours(F.col("_pixel"), F.col("channels")).items()])


def age_band_mask_tiles(
    tiles: DataFrame, ages: list[float], width: int, height: int, out_width: int, out_height: int, side: int = SIDE
) -> DataFrame:
    """:func:`.raster.age_band_mask` of the whole output image, made tile by tile without a shuffle of pixels."""
    return band_frames(tile_pixels(tiles, width, height, out_width, out_height, side), ages)
