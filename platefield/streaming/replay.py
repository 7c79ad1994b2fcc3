"""The edit log as a keyed stream: every edit is applied to the state of its plate as it arrives.

The durable state of a plate is what :func:`platefield.operators.replay.replay` would give for
the edits so far, with these edits. Edits that follow the last one are applied to it. Edits that come
out of order replay the plate's log, so after any number of batches, in any order
of files, the result is that of the batch job. The watermark only reports: edits behind it go to the
table of late rows and are counted, and are applied like all others.

A key of the stream is ``NEIGHBOURS`` plates with following ids, as a call of Python for a single plate costs more than
its edits. A key is one task by nature, so these plates and their logs must fit one; logs of any size
go through the batch job. Edits and plates are kept, and written, as JSON: what arrives is joined to the log as
it is, and only plates that are edited are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import cut_lineage

DELAY = "1 hour"
#: Plates of one key, a power of two. It is part of the state, so a checkpoint goes on with the number it began with.
NEIGHBOURS = 64
STATE = "plates array<struct<plate_id:long, plate:string, log:string, n_edits:long, last:long, late:long>>"
OUT = "plate_id long, seq long, n_edits long, n_late long, late array<long>, plate string"
POINTS = "array<array<double>>"
PLATE = f"base {POINTS}, frames map<string, struct<time:double, points:{POINTS}>>"
NOTHING = '{"top": -1, "base": [], "frames": {}}'


def _put(points: list, idx, u, v) -> None:
    if idx is not None and 0 <= idx < len(points):
        old = points[idx]
        points[idx] = [old[0] if u is None else u, old[1] if v is None else v]


def apply_edit(plate: dict, edit: dict) -> None:
    """One edit, without its NULLs, on a plate ``{top, base: [[u, v]], frames: {key: {time, points}}}``."""
    op, kf, idx, u, v = (edit.get(c) for c in ("op", "kf_seq", "point_idx", "u", "v"))
    base, frames = plate["base"], plate["frames"]
    frame = frames.get(str(kf))
    if op == "append":
        for points in (base, *(f["points"] for f in frames.values())):
            points.append([u, v])
    elif op == "delete":
        if idx is not None and 0 <= idx < len(base):
            for points in (base, *(f["points"] for f in frames.values())):
                del points[idx]
    elif op == "move":
        if kf is None or frame is not None:
            _put(base if kf is None else frame["points"], idx, u, v)
    elif op == "add":
        frames[str(plate["top"] + 1 + edit["seq"])] = {"time": edit.get("time"), "points": [list(p) for p in base]}
    elif op == "retime" and frame is not None:
        frame["time"] = edit.get("time")
    elif op == "drop":
        frames.pop(str(kf), None)


def _by_plate(batches: Iterator[pd.DataFrame]) -> dict[int, tuple[str, list]]:
    """Per plate its first state and its edits ``(seq, ts_ms, edit)``."""
    plates: dict[int, tuple[str, list]] = {}
    for rows in batches:
        columns = [rows[c].tolist() for c in ("plate_id", "seq", "ts_ms", "edit", "first")]
        for plate_id, seq, ts, edit, first in zip(*columns):
            if plate_id not in plates:
                plates[plate_id] = (first if isinstance(first, str) else NOTHING, [])
            plates[plate_id][1].append((seq, ts, edit))
    return plates


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs()
    states = {one[0]: tuple(one) for one in state.get[0]} if state.exists else {}
    out = []
    for plate_id, (start, fresh) in _by_plate(batches).items():
        _, text, log, n_edits, last, late = states.get(plate_id, (plate_id, start, "", 0, None, 0))
        fresh.sort(key=lambda e: e[0])
        behind = [seq for seq, ts, _ in fresh if ts is not None and ts < mark]
        todo = ",".join(e[2] for e in fresh)
        log = f"{log},{todo}" if log else todo
        edits = json.loads(f"[{todo}]")
        if last is not None and fresh[0][0] <= last:
            text, edits = start, sorted(json.loads(f"[{log}]"), key=lambda e: e["seq"])
        plate = json.loads(text)
        for edit in edits:
            apply_edit(plate, edit)
        text, n_edits, last, late = json.dumps(plate), n_edits + len(fresh), edits[-1]["seq"], late + len(behind)
        states[plate_id] = (plate_id, text, log, n_edits, last, late)
        out.append((plate_id, last, n_edits, late, behind, text))
    state.update((list(states.values()),))
    yield pd.DataFrame(out, columns=["plate_id", "seq", "n_edits", "n_late", "late", "plate"])


def first_states(base: DataFrame, keyframes: DataFrame) -> DataFrame:
    """``(plate_id, first)``: the state of each plate before its log, as text."""
    xy = lambda: F.transform(F.array_sort(F.collect_list(F.struct("point_idx", "u", "v"))), lambda p: F.array(p["u"], p["v"]))
    points = base.groupBy("plate_id").agg(xy().alias("base"))
    frames = keyframes.groupBy("plate_id", "kf_seq").agg(F.first("time").alias("time"), xy().alias("points"))
    one = F.concat(
        F.lit('{"time": '), F.coalesce(F.col("time").cast("string"), F.lit("null")), F.lit(', "points": '), F.to_json("points"), F.lit("}")
    )
    texts = frames.groupBy("plate_id").agg(
        F.max("kf_seq").alias("top"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("kf_seq").cast("string"), F.lit('": '), one))), ", ").alias("frames"),
    )
    joined = points.join(texts, "plate_id", "full_outer")
    text = F.concat(
        F.lit('{"top": '), F.coalesce("top", F.lit(-1)).cast("string"), F.lit(', "base": '),
        F.coalesce(F.to_json("base"), F.lit("[]")), F.lit(', "frames": {'), F.coalesce("frames", F.lit("")), F.lit("}}"),
    )
    return joined.select("plate_id", text.alias("first"))


def run_replay_stream(
    log: DataFrame, base: DataFrame, keyframes: DataFrame, out: str, checkpoint: str, delay: str = DELAY
) -> StreamingQuery:
    """Apply all edits that are there now to the state kept at ``checkpoint``; may be called again for more.

    ``log`` is a stream of edits with their time ``ts``. Each batch writes the plates it
    touched, and its late rows, below ``out`` under its number; a batch that runs again replaces what it wrote.
    """
    started = log.where("plate_id IS NOT NULL").join(cut_lineage(first_states(base, keyframes)), "plate_id", "left")
    # As JSON an edit keeps whole numbers whole; NULLs are left out, and NaN is one.
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    edit = F.to_json(F.struct("seq", "op", "kf_seq", "point_idx", number("time"), number("u"), number("v")))
    edits = started.withWatermark("ts", delay).select(
        F.expr(f"shiftright(plate_id, {NEIGHBOURS.bit_length() - 1})").alias("key"), "plate_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), edit.alias("edit"), "first"
    )
    states = edits.groupBy("key").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    query = (
        states.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _written(spark: SparkSession, out: str) -> DataFrame:
    # An empty batch has no rows and no plate.
    return spark.read.schema(f"{OUT}, batch_id long").option("basePath", out).parquet(out)


def read_state(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """``(base_point, keyframe)`` after the last batch. Plates without any edit are not in it."""
    rows = _written(spark, out)
    newest = rows.groupBy("plate_id").agg(F.max("batch_id").alias("batch_id"))
    plate = F.from_json("plate", PLATE, {"mode": "FAILFAST"})
    frame = lambda kf, time, points: F.struct(kf.cast("long").alias("kf_seq"), time.alias("time"), points.alias("points"))
    frames = F.concat(
        F.array(frame(F.lit(-1), F.lit(0.0), F.col("p.base"))),
        F.transform(F.map_entries("p.frames"), lambda f: frame(f["key"], f["value"]["time"], f["value"]["points"])),
    )
    points = (
        rows.join(newest, ["plate_id", "batch_id"]).select("plate_id", plate.alias("p"))
        .select("plate_id", F.explode(frames).alias("f"))
        .select("plate_id", "f.kf_seq", "f.time", F.posexplode("f.points").alias("point_idx", "p"))
        .select("plate_id", "kf_seq", "time", "point_idx", F.col("p")[0].alias("u"), F.col("p")[1].alias("v"))
    )
    base = points.where("kf_seq = -1").select("plate_id", "point_idx", "u", "v")
    return base, points.where("kf_seq <> -1")


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """``(plate_id, seq, batch_id)`` of every edit that came behind the watermark; all were applied."""
    return _written(spark, out).select("plate_id", F.explode("late").alias("seq"), "batch_id")


def late_counts(spark: SparkSession, out: str) -> DataFrame:
    """``(plate_id, n_edits, n_late)`` of the edits so far."""
    rows = _written(spark, out)
    return rows.groupBy("plate_id").agg(F.max("n_edits").alias("n_edits"), F.max("n_late").alias("n_late"))
