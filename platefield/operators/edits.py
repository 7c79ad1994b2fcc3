"""Edits of plates as table jobs.

Each takes the state (``base_point``, ``keyframe``) and a table of edits, and
returns the new state. A plate may have any number of edits in a batch; how edits of one
plate meet is written at each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keyframes import interpolate
from .ranking import with_position

BASE_COLUMNS = ["plate_id", "point_idx", "u", "v"]
#: Frames and points of a plate that meet in one key when points are appended to frames.
CELL_ROWS = 1024
FRAME_COLUMNS = ["plate_id", "kf_seq", "time", "point_idx", "u", "v"]


def upsert_keyframe(base: DataFrame, keyframes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set the points of a plate at a time; per time the edit with the highest ``seq`` counts.

    ``edits(plate_id, seq, time, point_idx, u, v)``. Time 0 replaces the base. An
    existing frame of exactly that time is replaced, the first one if there are
    several; otherwise a frame is added, ordered after the present ones.
    """
    asked = edits.groupBy("plate_id", "time").agg(
        F.max("seq").alias("seq"), F.min("seq").alias("first_seq")
    )
    rows = edits.join(asked, ["plate_id", "time", "seq"])
    new_base = rows.where("time = 0").select(*BASE_COLUMNS)
    kept_base = base.join(asked.where("time = 0").select("plate_id"), "plate_id", "left_anti")

    present = keyframes.groupBy("plate_id", "time").agg(F.min("kf_seq").alias("kf_seq"))
    top = keyframes.groupBy("plate_id").agg(F.max("kf_seq").alias("top"))
    hit = asked.where("time <> 0").join(present, ["plate_id", "time"])
    kept = keyframes.join(hit.select("plate_id", "kf_seq"), ["plate_id", "kf_seq"], "left_anti")
    placed = (
        rows.where("time <> 0")
        .join(present, ["plate_id", "time"], "left")
        .join(top, "plate_id", "left")
        .withColumn(
            "kf_seq",
            F.coalesce("kf_seq", F.coalesce("top", F.lit(-1).cast("bigint")) + 1 + F.col("first_seq")),
        )
    )
    return (
        kept_base.select(*BASE_COLUMNS).unionByName(new_base),
        kept.select(*FRAME_COLUMNS).unionByName(placed.select(*FRAME_COLUMNS)),
    )


def _crossed(frames: DataFrame, placed: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every frame of a plate with every row of ``placed(plate_id, _at, ...)``.

    Both are cut into cells of ``cell_rows`` of a plate, and a pair meets by plate and both
    cells, so no key has more than the square of that, whatever a plate holds.
    """
    numbered = with_position(cut_lineage(frames), ["plate_id"], "kf_seq", "_nth")
    left = cut_lineage(numbered.withColumn("_frames", F.floor(F.col("_nth") / cell_rows)).drop("_nth"))
    right = cut_lineage(placed.withColumn("_points", F.floor(F.col("_at") / cell_rows)))
    cells = left.select("plate_id", "_frames").distinct().join(right.select("plate_id", "_points").distinct(), "plate_id")
    return left.join(cells, ["plate_id", "_frames"]).join(
        right.join(cells, ["plate_id", "_points"]), ["plate_id", "_frames", "_points"]
    )


def append_point(base: DataFrame, keyframes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add points at the end of the base and of every frame, in order of ``seq``; ``edits(plate_id, seq, u, v)``."""
    placed = with_position(edits.select("plate_id", "seq", "u", "v"), ["plate_id"], "seq", "_at").drop("seq")
    counts = base.groupBy("plate_id").agg(F.count(F.lit(1)).alias("n"))
    to_base = placed.join(counts, "plate_id", "left").select(
        "plate_id", (F.coalesce("n", F.lit(0)) + F.col("_at")).cast("int").alias("point_idx"), "u", "v"
    )
    frames = keyframes.groupBy("plate_id", "kf_seq").agg(
        F.first("time").alias("time"), F.count(F.lit(1)).alias("n")
    )
    to_frames = _crossed(frames, placed).withColumn("point_idx", (F.col("n") + F.col("_at")).cast("int"))
    return (
        base.select(*BASE_COLUMNS).unionByName(to_base),
        keyframes.select(*FRAME_COLUMNS).unionByName(to_frames.select(*FRAME_COLUMNS)),
    )


def _without_points(points: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    left = points.join(gone, ["plate_id", "point_idx"], "left_anti")
    return with_position(left, keys, "point_idx", "_at").withColumn("point_idx", F.col("_at").cast("int")).drop("_at")


def delete_point(base: DataFrame, keyframes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove points from the base and every frame; later indices move down.

    ``edits(plate_id, point_idx)``; all indices are those before the batch, which count
    from 0 without holes, so what is left is numbered by its positions.
    """
    gone = cut_lineage(edits.select("plate_id", "point_idx").distinct())
    return (
        _without_points(base.select(*BASE_COLUMNS), ["plate_id"], gone).select(*BASE_COLUMNS),
        _without_points(keyframes.select(*FRAME_COLUMNS), ["plate_id", "kf_seq"], gone).select(*FRAME_COLUMNS),
    )


def find_moved_point(
    points: DataFrame, moves: DataFrame, keys: tuple[str, ...] = ("plate_id",), within: tuple[str, ...] = ()
) -> DataFrame:
    """``(*keys, new_u, new_v, point_idx)``: the first point exactly at the old position.

    ``moves`` has ``keys``, the old and the new position; further columns are kept. A move looks
    into every set of points that the columns ``within`` of ``points`` tell apart.
    """
    at = moves.withColumnsRenamed({"old_u": "u", "old_v": "v"})
    more = [c for c in at.columns if c not in ("u", "v")]
    return points.join(at, [*keys, "u", "v"]).groupBy(*within, *more).agg(F.min("point_idx").alias("point_idx"))


def move_point(
    base: DataFrame, keyframes: DataFrame, moves: DataFrame, mode: str = "extreme"
) -> tuple[DataFrame, DataFrame]:
    """Move the points seen at ``old`` at time t and set the whole plate at t.

    ``moves(plate_id, seq, t, old_u, old_v, new_u, new_v)``; all positions are those before
    the batch. Moves at one time of a plate set one frame, ordered by the last of them, and
    the last move of a point counts. If no point matches, the interpolated plate is still set at t.
    """
    asked = cut_lineage(moves.groupBy("plate_id", "t").agg(F.max("seq").alias("seq")))
    now = cut_lineage(interpolate(base, keyframes, asked.select("plate_id", "t"), mode))
    hit = find_moved_point(now, moves, ("plate_id", "t"))
    last = hit.groupBy("plate_id", "t", "point_idx").agg(F.max_by(F.struct("new_u", "new_v"), "seq").alias("_new"))
    moved = now.join(last, ["plate_id", "t", "point_idx"], "left").join(asked, ["plate_id", "t"])
    edits = moved.select(
        "plate_id", "seq", F.col("t").alias("time"), "point_idx",
        F.coalesce("_new.new_u", "u").alias("u"), F.coalesce("_new.new_v", "v").alias("v"),
    )
    return upsert_keyframe(base, keyframes, edits)


def add_keyframe(base: DataFrame, keyframes: DataFrame, plates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy the latest frame of a plate to 0.1 after it, once per row of ``plates(plate_id, seq)``, each 0.1 after the one before.

    Without frames the base is copied, from 0.1 on. Of several latest frames the first is copied.
    """
    latest = keyframes.groupBy("plate_id").agg(
        F.max("time").alias("last_time"),
        F.max_by("kf_seq", F.struct("time", -F.col("kf_seq"))).alias("kf_seq"),
    )
    placed = with_position(plates.select("plate_id", "seq"), ["plate_id"], "seq", "_at")
    asked = cut_lineage(placed.join(latest, "plate_id", "left").withColumn(
        "new_time", F.coalesce("last_time", F.lit(0.0)) + (F.col("_at") + 1) * F.lit(0.1)
    ))
    copied = asked.join(
        keyframes.select("plate_id", "kf_seq", "point_idx", "u", "v"), ["plate_id", "kf_seq"]
    )
    fresh = asked.where("kf_seq is null").join(base, "plate_id")
    columns = ["plate_id", "seq", F.col("new_time").alias("time"), "point_idx", "u", "v"]
    return upsert_keyframe(base, keyframes, copied.select(*columns).unionByName(fresh.select(*columns)))


def delete_keyframe(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Remove frames; ``edits(plate_id, kf_seq)``."""
    return keyframes.join(edits, ["plate_id", "kf_seq"], "left_anti").select(*FRAME_COLUMNS)


def retime_keyframe(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Change the time of frames in place; two frames may end up at one time.

    ``edits(plate_id, seq, kf_seq, time)``; the highest ``seq`` per frame counts.
    """
    last = edits.groupBy("plate_id", "kf_seq").agg(F.max_by("time", "seq").alias("_time"))
    joined = keyframes.join(last, ["plate_id", "kf_seq"], "left")
    return joined.withColumn("time", F.coalesce("_time", "time")).select(*FRAME_COLUMNS)


def set_coordinate(base: DataFrame, keyframes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set u or v of single points.

    ``edits(plate_id, seq, kf_seq, point_idx, axis, value)``; a NULL ``kf_seq``
    means the base; per coordinate the highest ``seq`` counts.
    """
    frame = F.coalesce("kf_seq", F.lit(-1).cast("bigint"))
    last = (
        edits.withColumn("kf_seq", frame)
        .groupBy("plate_id", "kf_seq", "point_idx")
        .agg(*[F.max_by(F.when(F.col("axis") == c, F.col("value")), F.when(F.col("axis") == c, F.col("seq"))).alias(f"_{c}") for c in "uv"])
    )
    both = base.select(
        "plate_id", F.lit(-1).cast("bigint").alias("kf_seq"), F.lit(None).cast("double").alias("time"), "point_idx", "u", "v"
    ).unionByName(keyframes.select(*FRAME_COLUMNS))
    done = both.join(last, ["plate_id", "kf_seq", "point_idx"], "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in "uv"}
    )
    return (
        done.where("kf_seq = -1").select(*BASE_COLUMNS),
        done.where("kf_seq <> -1").select(*FRAME_COLUMNS),
    )
