"""Points between keyframes.

``base_point(plate_id, point_idx, u, v)`` is the plate at time 0;
``keyframe(plate_id, kf_seq, time, point_idx, u, v)`` holds one row per point of a
frame. ``queries(plate_id, t)`` asks for the plate at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import PART_ROWS, carried, cut_by_counts
from .spread import SHARE, copied, spread

BASE = -1  # kf_seq of the base points, read as a frame at time 0


def extreme_frames(keyframes: DataFrame, queries: DataFrame) -> DataFrame:
    """Lower = earliest frame <= t, upper = latest frame >= t; of equal times the last frame.

    These are the two ends of the timeline, so one aggregate per plate answers
    every query.
    """
    ends = keyframes.groupBy("plate_id").agg(
        F.min("time").alias("t0"),
        F.min_by("kf_seq", F.struct("time", -F.col("kf_seq"))).alias("s0"),
        F.max("time").alias("t1"),
        F.max_by("kf_seq", F.struct("time", "kf_seq")).alias("s1"),
    )
    joined = queries.join(ends, "plate_id", "left")
    low, high = F.col("t0") <= F.col("t"), F.col("t1") >= F.col("t")
    return _with_fallbacks(
        joined,
        F.when(low, F.col("s0")), F.when(low, F.col("t0")),
        F.when(high, F.col("s1")), F.when(high, F.col("t1")),
    )


def bracket_frames(keyframes: DataFrame, queries: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Lower = latest frame <= t, upper = earliest frame >= t: the neighbours in time.

    Frames and queries of a plate are merged in parts of about ``part_rows`` rows, whatever
    unit the times have and however close they lie.
    """
    frames = keyframes.groupBy("plate_id", "time").agg(F.max("kf_seq").alias("seq"))
    asked = queries.select("plate_id", "t").distinct()
    rows = frames.select(
        "plate_id", F.col("time").alias("t"), F.struct(F.col("time").alias("time"), F.col("seq").alias("seq")).alias("f")
    ).unionByName(asked.withColumn("f", F.lit(None).cast("struct<time:double,seq:bigint>")))
    # A frame and a query of one time are one row.
    rows = rows.groupBy("plate_id", "t").agg(F.max("f").alias("f"), F.bool_or(F.col("f").isNull()).alias("asked"))
    cut = cut_by_counts(rows, ["plate_id"], ["t"], part_rows)
    lower = carried(cut, ["plate_id"], ["t"], {"lo": "f"})
    answered = carried(lower, ["plate_id"], ["t"], {"up": "f"}, ahead=True).where("asked")
    # A query time may be asked more than once; its answer is the same.
    return _with_fallbacks(
        queries.join(answered.select("plate_id", "t", "lo", "up"), ["plate_id", "t"]),
        F.col("lo.seq"), F.col("lo.time"), F.col("up.seq"), F.col("up.time"),
    )


def _with_fallbacks(df: DataFrame, lo_seq: Column, lo_time: Column, up_seq: Column, up_time: Column) -> DataFrame:
    """No lower frame: the base points at time 0. No upper frame: the lower one."""
    lo_seq = F.coalesce(lo_seq, F.lit(BASE).cast("bigint"))
    lo_time = F.coalesce(lo_time, F.lit(0.0))
    return df.select(
        "plate_id", "t",
        lo_seq.alias("lower_seq"), lo_time.alias("lower_time"),
        F.coalesce(up_seq, lo_seq).alias("upper_seq"), F.coalesce(up_time, lo_time).alias("upper_time"),
    )


def interpolate(
    base: DataFrame, keyframes: DataFrame, queries: DataFrame, mode: str = "extreme", share: int = SHARE
) -> DataFrame:
    """``(plate_id, t, point_idx, u, v)`` of each plate at each different time asked.

    ``mode="extreme"`` blends the two ends of the timeline, ``mode="bracket"`` the
    neighbours of t. A point the upper frame lacks stays where the lower one has it. All times of a plate may
    want the same two frames: no key of the join holds much more than 1/``share`` of what is wanted.
    """
    if mode not in ("extreme", "bracket"):
        raise ValueError(f"unknown mode {mode!r}")
    choose = extreme_frames if mode == "extreme" else bracket_frames
    span = F.col("upper_time") - F.col("lower_time")
    alpha = (F.col("t") - F.col("lower_time")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    # Both frames of a query fetch their points in one join, so the points are
    # shuffled once; the two halves then meet per output row.
    ends = F.array(
        F.struct(F.lit(True).alias("low"), F.col("lower_seq").alias("kf_seq")),
        F.struct(F.lit(False).alias("low"), F.col("upper_seq").alias("kf_seq")),
    )
    wanted = (
        choose(keyframes, queries.select("plate_id", "t").distinct())
        .select("plate_id", "t", alpha.alias("alpha"), F.explode(ends).alias("e"))
        .select("plate_id", "t", "alpha", "e.low", "e.kf_seq")
    )
    points = keyframes.select("plate_id", "kf_seq", "point_idx", "u", "v").unionByName(
        base.select("plate_id", F.lit(BASE).cast("bigint").alias("kf_seq"), "point_idx", "u", "v")
    )
    frame = ["plate_id", "kf_seq"]
    dealt, heavy = spread(cut_lineage(wanted), frame, share)
    found = (
        dealt.join(copied(points, frame, heavy), [*frame, "_part"])
        .groupBy("plate_id", "t", "point_idx")
        .agg(
            F.max("alpha").alias("alpha"),
            F.bool_or("low").alias("has_lower"),
            *[F.max(F.when(F.col("low"), F.col(c))).alias(f"{c}0") for c in "uv"],
            *[F.max(F.when(~F.col("low"), F.col(c))).alias(f"{c}1") for c in "uv"],
        )
        .where("has_lower")
    )
    blend = lambda a, b: F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * F.col("alpha")
    return found.select("plate_id", "t", "point_idx", blend("u0", "u1").alias("u"), blend("v0", "v1").alias("v"))
