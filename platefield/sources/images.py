"""Image files as raster tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import counted, gen_pixel_grid

PIXELS = "origin string, width int, py int, px int, r smallint, g smallint, b smallint, a smallint"


#: Pixels decoded at once.
AT_ONCE = 1 << 20


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of interleaved bytes to one row per pixel; Spark hands out blue first."""
    for batch in batches:
        for channels, lines in batch.groupby("nChannels", sort=False):
            counts = lines["line"].map(len).to_numpy() // channels
            part = (np.cumsum(counts) - counts) // AT_ONCE
            for _, some in lines.assign(_n=counts).groupby(part, sort=False):
                n = some["_n"].to_numpy()
                px = np.frombuffer(b"".join(some["line"]), dtype=np.uint8).reshape(-1, channels).astype(np.int16)
                blue, green, red = (px[:, min(k, channels - 1)] for k in range(3))
                start = np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame(
                    {
                        "origin": np.repeat(some["origin"].to_numpy(), n), "width": np.repeat(n, n).astype(np.int32),
                        "py": np.repeat(some["py"].to_numpy(), n).astype(np.int32),
                        "px": (np.arange(len(px)) - start).astype(np.int32),
                        "r": red, "g": green, "b": blue, "a": px[:, 3] if channels == 4 else np.int16(255),
                    }
                )


def write_bitmaps(raster: DataFrame, path: str, width: int, height: int) -> None:
    """Write each raster as an uncompressed image file below ``path``, in a folder ``raster_id=<id>``.

    Executors write the files. Pixels that ``raster(raster_id, px, py, r, g, b)`` lacks are black, those
    outside ``width`` x ``height`` left out; an image file is one record, so it must fit in one. The file has a line feed behind
    its last pixel, which readers skip.
    """
    ids = raster.select("raster_id").distinct().select(
        "raster_id", F.lit(width).alias("w"), F.lit(height).alias("h"), F.lit(0).alias("x0"), F.lit(0).alias("y0")
    )
    grid = gen_pixel_grid(ids, "w", "h", "x0", "y0").select("raster_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"))
    code = F.concat(*[F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("long")), 2, "0") for c in "bgr"])
    dense = grid.join(raster.select("raster_id", "px", "py", "r", "g", "b"), ["raster_id", "px", "py"], "left")
    # Lines end at whole groups of four bytes and run from the bottom up.
    stride = -(-3 * width // 4) * 4
    ordered = lambda by, value: F.array_join(F.array_sort(F.collect_list(F.struct(by.alias("k"), value.alias("v"))))["v"], "")
    lines = dense.groupBy("raster_id", "py").agg(F.rpad(ordered(F.col("px"), code), 2 * stride, "0").alias("line"))
    size = stride * height
    head = struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    files = lines.groupBy("raster_id").agg(F.unhex(F.concat(F.lit(head.hex()), ordered(-F.col("py"), F.col("line")))).alias("bytes"))
    # Text is written byte by byte as it is; one record makes one file.
    files.select("raster_id", F.col("bytes").cast("string")).write.partitionBy("raster_id").option("maxRecordsPerFile", 1).text(path)


def scan_raster(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Every image below ``path`` in ``width`` x ``height`` pixels, resized without smoothing.

    ``(origin, px, py, r, g, b, a)``. Files that are no images are skipped. An
    image is split into lines before its bytes are decoded, and only lines that
    the resized image shows are kept.
    """
    images = (
        spark.read.format("image").option("dropInvalid", True).load(path)
        .select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    )
    source_line = F.floor((F.col("py") + 0.5) * F.col("height") / float(height)).cast("int")
    lines = images.withColumn("py", F.explode(counted(F.lit(height)))).withColumn("_sy", source_line)
    cut = lines.select(
        "origin", "nChannels", F.col("py").cast("int").alias("py"),
        F.expr("substring(data, _sy * width * nChannels + 1, width * nChannels)").alias("line"),
    )
    pixels = cut.mapInPandas(_decode, PIXELS)
    # The run of target columns that show a source column.
    first = lambda k: F.ceil(k * float(width) / F.col("width") - 0.5).cast("int")
    low, high = first(F.col("px").cast("double")), first(F.col("px") + F.lit(1.0)) - 1
    return pixels.withColumn("px", F.explode(F.when(low <= high, F.sequence(low, high)))).select(
        "origin", "px", "py", "r", "g", "b", "a"
    )
