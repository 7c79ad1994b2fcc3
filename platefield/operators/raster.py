"""Rasters as long tables ``(raster_id, px, py, r, g, b, a)``, y downwards.

A pixel without a row is transparent black, as in a new image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import age_hue, hue_to_rgb
from ..functions.numeric import clamp, clamp_int, half_up

CHANNELS = ("r", "g", "b", "a")


def clamp_pixel(px: Column, py: Column, width: int, height: int) -> tuple[Column, Column]:
    """Nearest pixel inside the image."""
    return (
        clamp_int(px, 0, width - 1).cast("int"),
        clamp_int(py, 0, height - 1).cast("int"),
    )


def raster_put(base: DataFrame, puts: DataFrame, width: int, height: int) -> DataFrame:
    """Overwrite pixels by ``puts(raster_id, seq, px, py, r, g, b, a)``; the highest ``seq`` wins.

    Coordinates outside the image hit its edge. Writes are reduced to one per
    pixel on the map side before they meet the base.
    """
    x, y = clamp_pixel(F.col("px"), F.col("py"), width, height)
    last = (
        puts.withColumns({"px": x, "py": y})
        .groupBy("raster_id", "px", "py")
        .agg(*[F.max_by(c, "seq").alias(f"new_{c}") for c in CHANNELS])
    )
    return base.join(last, ["raster_id", "px", "py"], "full_outer").select(
        "raster_id", "px", "py",
        *[F.coalesce(f"new_{c}", c).cast("smallint").alias(c) for c in CHANNELS],
    )


def raster_sample(
    points: DataFrame, raster: DataFrame, width: int, height: int, wrap: bool = False
) -> DataFrame:
    """Colour under each row of ``points(raster_id, px, py, ...)``, coordinates clamped to the edge.

    With ``wrap`` a column outside the map continues on its other side.

    An equi-join on the pixel: a small raster is broadcast by its run-time size,
    and a hot pixel is split by the adaptive skew join.
    """
    px = F.pmod(F.col("px"), F.lit(width)) if wrap else F.col("px")
    x, y = clamp_pixel(px, F.col("py"), width, height)
    lookup = raster.select(
        F.col("raster_id"), F.col("px").alias("_x"), F.col("py").alias("_y"), *CHANNELS
    )
    zero = F.lit(0).cast("smallint")
    return (
        points.withColumns({"_x": x, "_y": y})
        .join(lookup, ["raster_id", "_x", "_y"], "left")
        .withColumns({c: F.coalesce(c, zero) for c in CHANNELS})
        .drop("_x", "_y")
    )


def resize_nearest(raster: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Resize without smoothing: a target pixel takes the source pixel under its centre.

    Each source pixel works out the run of target pixels it covers, so there is no
    join and no shuffle.
    """

    def run(c: str, old: int, new: int) -> Column:
        first = lambda k: F.ceil(k * float(new) / float(old) - 0.5).cast("int")
        low, high = first(F.col(c).cast("double")), first(F.col(c) + F.lit(1.0)) - 1
        return F.when(low <= high, F.sequence(low, high))

    return (
        raster.withColumn("_x", F.explode(run("px", width, to_width)))
        .withColumn("_y", F.explode(run("py", height, to_height)))
        .select("raster_id", F.col("_x").alias("px"), F.col("_y").alias("py"), *CHANNELS)
    )


def age_band_mask(
    grid: DataFrame, raster: DataFrame, ages: list[float], width: int, height: int
) -> DataFrame:
    """For each age, the pixels within 3 steps of it in the ramp colour, the others transparent.

    ``grid(raster_id, px, py)`` is the output image; it may be larger than the
    ``width`` x ``height`` raster, whose edge then repeats.
    """
    return band_frames(raster_sample(grid, raster, width, height), ages)


def band_frames(sampled: DataFrame, ages: list[float]) -> DataFrame:
    """The mask of each age over ``sampled(raster_id, px, py, r)``."""
    frames = sampled.withColumn("age", F.explode(F.array(*[F.lit(float(t)) for t in ages])))
    age = F.col("age")
    hue = age_hue(age)
    hit = (age < 0.99) & (F.abs(hue - F.col("r")) < 3)
    colours = dict(zip("rgb", hue_to_rgb(hue)))
    return frames.select(
        "raster_id", "age", "px", "py",
        *[F.when(hit, colours[c]).otherwise(F.lit(0)).cast("smallint").alias(c) for c in "rgb"],
        F.when(hit, F.lit(255)).otherwise(F.lit(0)).cast("smallint").alias("a"),
    )


def age_threshold_mask(raster: DataFrame, time: float) -> DataFrame:
    """Step each colour channel at ``time``, then show what stays dark at half its alpha.

    The step table has round(255 t) zeros and round(255 (1 - t)) ones, looked up by
    the channel in 0..1. Alpha becomes ``0.5 * alpha - red`` in 0..1.
    """
    from math import floor

    zeros = floor(time * 255 + 0.5)
    entries = zeros + floor((1 - time) * 255 + 0.5)

    def step(c: str) -> Column:
        at = F.least(F.floor(F.col(c) / 255.0 * float(entries)), F.lit(entries - 1))
        return F.when(at >= zeros, F.lit(1.0)).otherwise(F.lit(0.0))

    red = step("r")
    alpha = clamp(F.col("a") / 255.0 * 0.5 - red, 0.0, 1.0)
    full = lambda c: half_up(c * 255.0).cast("smallint")
    return raster.select(
        "raster_id", "px", "py",
        full(red).alias("r"), full(step("g")).alias("g"), full(step("b")).alias("b"),
        full(alpha).alias("a"),
    )
