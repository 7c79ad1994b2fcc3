"""Plates as JSON documents, their backups, and flat geometry buffers.

A document is an array of polygons ``{points: [{x, y}], timeline: [{time, points}]}``.
A plate too large for one string is written as several documents, each a slice of
its points and frames; ``point_from`` and ``frame_from`` say where a slice starts
and are absent in hand-made documents.
"""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import SEQ_BITS, running_total, with_position

_POINTS = "array<struct<x: double, y: double>>"
PLATES_SCHEMA = (
    "array<struct<plate_id: bigint, point_from: int, frame_from: bigint, "
    f"points: {_POINTS}, timeline: array<struct<frame: bigint, time: double, points: {_POINTS}>>>>"
)
SLICE_POINTS = 4096
SLICE_FRAMES = 1024
#: Points of the frames of one document, about, and the bytes no document passes: a point takes at
#: most 64, a frame 96, and the last frame of a slice may go over by its own points.
SLICE_SIZE = 1 << 16
MOST_BYTES = 64 * (SLICE_SIZE + 2 * SLICE_POINTS) + 96 * SLICE_FRAMES + 1024


class Documents(NamedTuple):
    """What documents hold: every plate and frame, also those without points, and what couldn't be read."""

    plates: DataFrame  # doc_id, plate_id
    frames: DataFrame  # doc_id, plate_id, kf_seq, time
    base: DataFrame  # doc_id, plate_id, point_idx, u, v
    keyframes: DataFrame  # doc_id, plate_id, kf_seq, time, point_idx, u, v
    broken: DataFrame  # doc_id, doc


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", doc: str = "doc") -> Documents:
    """All that ``docs`` hold, without loss.

    A polygon without ``plate_id`` is numbered by its place in the document, a frame without ``frame``
    by its place behind ``frame_from``. A document that isn't an array of polygons with fields of these types,
    the empty text too, is broken and contributes nothing else; a NULL one is missing, not broken.
    """
    # A record has a column for what is malformed in it; in an array, the text must be one value and no more.
    whole = F.from_json(
        F.concat(F.lit('{"polygons": '), doc, F.lit("}")), f"polygons {PLATES_SCHEMA}, _broken string", {"columnNameOfCorruptRecord": "_broken"}
    )
    read = docs.where(F.col(doc).isNotNull()).select(
        doc_id, F.col(doc).alias("_doc"), whole.alias("_whole"), F.from_json(F.concat(F.lit("["), doc, F.lit("]")), "array<string>").alias("_values")
    ).select(doc_id, "_doc", "_values", "_whole.*").withColumnRenamed("polygons", "_polygons")
    bad = F.col("_polygons").isNull() | F.col("_broken").isNotNull() | ~F.coalesce(F.size("_values") == 1, F.lit(False))
    broken = read.where(bad).select(doc_id, F.col("_doc").alias(doc))
    polygons = read.where(~bad).select(doc_id, F.posexplode("_polygons").alias("_i", "p")).select(
        doc_id,
        F.coalesce("p.plate_id", "_i").cast("bigint").alias("plate_id"),
        F.coalesce("p.point_from", F.lit(0)).alias("_point"),
        F.coalesce("p.frame_from", F.lit(0)).cast("bigint").alias("_frame"),
        "p.points",
        "p.timeline",
    )
    point = [
        (F.col("_point") + F.col("_k")).alias("point_idx"), F.col("_xy.x").alias("u"), F.col("_xy.y").alias("v")
    ]
    base = polygons.select(doc_id, "plate_id", "_point", F.posexplode("points").alias("_k", "_xy")).select(
        doc_id, "plate_id", *point
    )
    slices = polygons.select(doc_id, "plate_id", "_point", "_frame", F.posexplode("timeline").alias("_f", "_kf")).select(
        doc_id, "plate_id", "_point", F.coalesce("_kf.frame", F.col("_frame") + F.col("_f")).alias("kf_seq"),
        F.col("_kf.time").alias("time"), F.col("_kf.points").alias("_points"),
    )
    keyframes = slices.select(doc_id, "plate_id", "_point", "kf_seq", "time", F.posexplode("_points").alias("_k", "_xy")).select(
        doc_id, "plate_id", "kf_seq", "time", *point
    )
    # A plate or frame in several slices is one.
    return Documents(
        polygons.select(doc_id, "plate_id").distinct(), slices.select(doc_id, "plate_id", "kf_seq", "time").distinct(), base, keyframes, broken
    )


def scan_plates_json(docs: DataFrame, doc_id: str = "doc_id", doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """``(base_point, keyframe)`` of ``docs``; :func:`scan_documents` has what is empty or malformed too."""
    read = scan_documents(docs, doc_id, doc)
    return read.base, read.keyframes


def plates_to_json(
    base: DataFrame, keyframes: DataFrame,
    slice_points: int = SLICE_POINTS, slice_frames: int = SLICE_FRAMES, slice_size: int = SLICE_SIZE,
    plates: DataFrame | None = None, frames: DataFrame | None = None,
) -> DataFrame:
    """Documents ``(plate_id, frame_from, point_from, doc)``, one array of one polygon slice each.

    Frames keep their order and are renumbered from 0. A slice has up to ``slice_points`` points of its frames, and
    frames until they have ``slice_size`` points, so no document passes ``MOST_BYTES``. ``plates(plate_id)`` and
    ``frames(plate_id, kf_seq, time)`` name those that have no points, and may name others.
    """
    xy = lambda: F.transform(
        F.array_sort(F.collect_list(F.struct("point_idx", "u", "v"))),
        lambda p: F.struct(p["u"].alias("x"), p["v"].alias("y")),
    ).alias("points")
    cut = F.expr(f"cast(point_idx div {slice_points} * {slice_points} as int)").alias("point_from")
    zero = F.lit(0).cast("bigint")
    points = base.groupBy("plate_id", cut).agg(xy()).withColumn("_slice", zero)

    known = keyframes.select("plate_id", "kf_seq", "time").distinct()
    if frames is not None:
        known = known.unionByName(frames.select("plate_id", "kf_seq", "time")).distinct()
    numbered = with_position(known, ["plate_id"], "kf_seq", "frame")
    met = numbered.select("plate_id", "kf_seq", "time", "frame").join(keyframes.drop("time"), ["plate_id", "kf_seq"], "left")
    whole = met.groupBy("plate_id", "frame", "time", F.coalesce(cut, F.lit(0)).alias("point_from")).agg(
        F.filter(F.array_sort(F.collect_list(F.struct("point_idx", "u", "v"))), lambda p: p["point_idx"].isNotNull()).alias("_p")
    ).withColumn("points", F.transform("_p", lambda p: F.struct(p["u"].alias("x"), p["v"].alias("y")))).drop("_p")
    weight = F.greatest(F.size("points") + 1, F.lit(-(-slice_size // slice_frames))).cast("bigint")
    placed = running_total(whole.withColumn("_w", weight), ["plate_id", "point_from"], "frame", "_w", SEQ_BITS)
    sliced = placed.groupBy("plate_id", "point_from", F.expr(f"before div {slice_size}").alias("_slice")).agg(
        F.array_sort(F.collect_list(F.struct("frame", "time", "points"))).alias("timeline")
    )
    joined = points.join(sliced, ["plate_id", "_slice", "point_from"], "full_outer")
    if plates is not None:
        empty = plates.select("plate_id").distinct().join(joined.select("plate_id").distinct(), "plate_id", "left_anti")
        joined = joined.unionByName(empty.withColumns({"_slice": zero, "point_from": F.lit(0)}), allowMissingColumns=True)
    first = F.coalesce(F.get("timeline", F.lit(0))["frame"], zero).alias("frame_from")
    polygon = F.struct(
        "plate_id", "point_from", "frame_from", F.coalesce("points", F.array().cast(_POINTS)).alias("points"), "timeline"
    )
    return joined.withColumn("frame_from", first).select("plate_id", "frame_from", "point_from", F.to_json(F.array(polygon)).alias("doc"))


def sink_plates_json(base: DataFrame, keyframes: DataFrame, path: str) -> None:
    """Replace the stored documents at ``path``."""
    plates_to_json(base, keyframes).write.mode("overwrite").parquet(path)


def snapshot_backup(spark, path: str, backups: str, stamp: str) -> DataFrame:
    """Add a copy of the stored documents under ``snapshot_ts=<stamp>`` and return it; the same stamp again replaces it."""
    # Colons and the like are no legal characters of a path everywhere; Spark reads them back from their codes.
    spark.read.parquet(path).write.mode("overwrite").parquet(f"{backups}/snapshot_ts={quote(stamp, safe='')}")
    return (
        spark.read.option("basePath", backups).parquet(backups).where(F.col("snapshot_ts").cast("string") == stamp)
    )


def geometry_flatten(
    rows: DataFrame, keys: list[str], seq: str, values: list[str], part_size: int = 65536
) -> DataFrame:
    """Vectors as flat single-precision buffers ``(keys, part, buffer)`` of ``part_size`` vectors each.

    ``seq`` is the dense vector number; the parts in order are the whole buffer.
    """
    vector = F.array(*[F.col(v).cast("float") for v in values])
    items = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), vector.alias("v"))))
    return (
        rows.groupBy(*keys, F.expr(f"{seq} div {part_size}").alias("part"))
        .agg(items.alias("_rows"))
        .select(*keys, "part", F.flatten(F.col("_rows.v")).alias("buffer"))
    )


def geometry_unflatten(
    buffers: DataFrame, keys: list[str], values: list[str], buffer: str = "buffer", part_size: int = 65536
) -> DataFrame:
    """Rows ``(keys, seq, values...)`` of flat buffers with one value per name in turn."""
    stride = len(values)
    count = F.expr(f"size({buffer}) div {stride}")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    at = buffers.select(*keys, "part", buffer, F.explode(index).alias("_i"))
    return at.select(
        *keys,
        (F.col("part") * part_size + F.col("_i")).alias("seq"),
        *[F.get(F.col(buffer), F.col("_i") * stride + k).alias(v) for k, v in enumerate(values)],
    )


def export_polygon_path(points: DataFrame, keys: list[str], seq: str, height: int, name: str = "path") -> DataFrame:
    """``"x,y x,y ..."`` of short point lists (triangle corners), in pixels divided by the height."""
    from ..functions.sphere import uv_to_pixel

    px, py = uv_to_pixel(F.col("u"), F.col("v"), height)
    text = F.concat(number_text(px / float(height)), F.lit(","), number_text(py / float(height)))
    items = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), text.alias("t"))))
    return points.groupBy(*keys).agg(F.array_join(items["t"], " ").alias(name))


def number_text(x):
    """Shortest text of a number, whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
