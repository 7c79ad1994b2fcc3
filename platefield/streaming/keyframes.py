"""The edit log as a stream: the last edit of a plate in each stretch of time is its keyframe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FRAME = "1 day"


def keyframe_updates(edits: DataFrame, frame: str = FRAME) -> DataFrame:
    """Last-write-wins keyframes of ``edits(plate_id, seq, ts, u, v)``: the edit of the greatest seq counts."""
    return (
        edits.groupBy("plate_id", F.window("ts", frame).alias("w"))
        .agg(
            F.max("seq").alias("seq"),
            F.max_by("u", "seq").alias("u"),
            F.max_by("v", "seq").alias("v"),
            F.count(F.lit(1)).alias("n_edits"),
        )
        .select("plate_id", F.col("w.start").alias("frame_start"), "seq", "u", "v", "n_edits")
    )


def run_keyframe_stream(edits: DataFrame, out: str, checkpoint: str, frame: str = FRAME) -> StreamingQuery:
    """Process what is there now, and all of it: no row is late and no frame has to wait to be finished.

    Each batch writes its own partial keyframes below ``out`` under its number, so a batch
    that runs again replaces what it wrote. No state is kept between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyframe_updates(batch, frame).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    query = (
        edits.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_keyframes(spark: SparkSession, out: str) -> DataFrame:
    """The keyframes of all batches so far; their partial ones combine before the shuffle."""
    parts = spark.read.option("basePath", out).parquet(out)
    return parts.groupBy("plate_id", "frame_start").agg(
        F.max("seq").alias("seq"),
        F.max_by("u", "seq").alias("u"),
        F.max_by("v", "seq").alias("v"),
        F.sum("n_edits").alias("n_edits"),
    )


def edit_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, a file or a folder of part files, as a stream of rows."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # A pattern for this name alone: a stream may not be given a plain file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
