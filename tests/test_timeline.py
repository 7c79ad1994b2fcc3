"""Interpolation, edits and the stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from platefield.operators import edits as E
from platefield.operators import keyframes as K
from platefield.operators.asof import cut_by_counts
from platefield.streaming import keyframes as ST

BASE = "plate_id bigint, point_idx int, u double, v double"
FRAME = "plate_id bigint, kf_seq bigint, time double, point_idx int, u double, v double"


def _plate(spark, base, frames):
    return (
        spark.createDataFrame([(0, i, float(u), float(u)) for i, u in enumerate(base)], BASE),
        spark.createDataFrame(
            [(0, s, t, i, float(u), float(u)) for s, (t, us) in enumerate(frames) for i, u in enumerate(us)], FRAME
        ),
    )


def _ask(spark, times, plate=0):
    return spark.createDataFrame([(plate, t) for t in times], "plate_id bigint, t double")


@pytest.mark.parametrize("mode", ["extreme", "bracket"])
def test_one_frame(spark, mode):
    base, frames = _plate(spark, [0], [(0.1, [1])])
    got = {r.t: r.u for r in K.interpolate(base, frames, _ask(spark, [0.0, 0.05, 0.1]), mode).collect()}
    assert got == {0.0: 0.0, 0.05: 0.5, 0.1: 1.0}


@pytest.mark.parametrize(
    "mode,want",
    [("extreme", [1.0, 1.0, 2.5, 4.0, 1.0]), ("bracket", [0.5, 1.0, 2.5, 4.0, 4.0])],
)
def test_two_frames(spark, mode, want):
    base, frames = _plate(spark, [0], [(0.1, [1]), (0.2, [4])])
    times = [0.05, 0.1, 0.15, 0.2, 0.3]
    got = {r.t: r.u for r in K.interpolate(base, frames, _ask(spark, times), mode).collect()}
    assert [got[t] for t in times] == pytest.approx(want)


def test_plate_without_frames_keeps_its_base(spark):
    base, frames = _plate(spark, [3, 7], [])
    for mode in ("extreme", "bracket"):
        got = {r.point_idx: r.u for r in K.interpolate(base, frames, _ask(spark, [0.4]), mode).collect()}
        assert got == {0: 3.0, 1: 7.0}


def test_modes_against_loops(spark):
    rnd = random.Random(7)
    frames, base, asks, want = [], [], [], {"extreme": {}, "bracket": {}}
    for plate in range(12):
        base.append((plate, 0, rnd.random(), 0.0))
        timeline = [(plate, s, rnd.choice([0.0, rnd.random(), 0.5]), 0, rnd.random(), 0.0) for s in range(rnd.randrange(6))]
        frames += timeline
        for t in [0.0, 0.25, 0.5, 0.75, 1.0]:
            asks.append((plate, t))
            for mode, lo, hi in (("extreme", min, max), ("bracket", max, min)):
                low = [f[2] for f in timeline if f[2] <= t]
                high = [f[2] for f in timeline if f[2] >= t]
                last = lambda time: [f for f in timeline if f[2] == time][-1]
                lower = last(lo(low)) if low else (plate, -1, 0.0, 0, base[-1][2], 0.0)
                upper = last(hi(high)) if high else lower
                a = (t - lower[2]) / ((upper[2] - lower[2]) or 1)
                want[mode][plate, t] = lower[4] + (upper[4] - lower[4]) * a
    base, frames = spark.createDataFrame(base, BASE), spark.createDataFrame(frames, FRAME)
    asked = spark.createDataFrame(asks, "plate_id bigint, t double")
    for mode in want:
        got = {(r.plate_id, r.t): r.u for r in K.interpolate(base, frames, asked, mode).collect()}
        assert got == pytest.approx(want[mode])


def _points(df):
    return sorted((r.time, r.point_idx, r.u) for r in df.collect())


def test_append_then_delete_point(spark):
    base, frames = _plate(spark, [1, 2], [(0.1, [3, 4]), (0.2, [5, 6])])
    edit = spark.createDataFrame([(0, 1, 9.0, 9.0)], "plate_id bigint, seq bigint, u double, v double")
    base, frames = E.append_point(base, frames, edit)
    assert _points(frames) == [(0.1, 0, 3), (0.1, 1, 4), (0.1, 2, 9), (0.2, 0, 5), (0.2, 1, 6), (0.2, 2, 9)]
    base, frames = E.delete_point(base, frames, spark.createDataFrame([(0, 0)], "plate_id bigint, point_idx int"))
    assert sorted((r.point_idx, r.u) for r in base.collect()) == [(0, 2), (1, 9)]
    assert _points(frames) == [(0.1, 0, 4), (0.1, 1, 9), (0.2, 0, 6), (0.2, 1, 9)]


def test_many_edits_of_one_plate_in_a_batch(spark):
    base, frames = _plate(spark, [1, 2, 3, 4], [(0.1, [5, 6, 7, 8])])
    edits = spark.createDataFrame([(0, s, float(90 + s), 0.0) for s in (7, -3, 12)], "plate_id bigint, seq bigint, u double, v double")
    base, frames = E.append_point(base, frames, edits)
    assert sorted((r.point_idx, r.u) for r in base.collect())[4:] == [(4, 87.0), (5, 97.0), (6, 102.0)]
    gone = spark.createDataFrame([(0, 0), (0, 2), (0, 5), (0, 2), (0, 50)], "plate_id bigint, point_idx int")
    base, frames = E.delete_point(base, frames, gone)
    assert sorted((r.point_idx, r.u) for r in base.collect()) == [(0, 2), (1, 4), (2, 87), (3, 102)]
    assert _points(frames) == [(0.1, 0, 6), (0.1, 1, 8), (0.1, 2, 87), (0.1, 3, 102)]
    ask = spark.createDataFrame([(0, 9), (0, 4)], "plate_id bigint, seq bigint")
    _, more = E.add_keyframe(base, frames, ask)
    assert [round(t, 9) for t, i, _ in _points(more) if i == 0] == [0.1, 0.2, 0.3]
    moves = spark.createDataFrame(
        [(0, 1, 0.0, 2.0, 2.0, 20.0, 0.0), (0, 3, 0.0, 2.0, 2.0, 21.0, 0.0), (0, 2, 0.0, 4.0, 4.0, 22.0, 0.0), (0, 4, 0.1, 6.0, 6.0, 23.0, 0.0)],
        "plate_id bigint, seq bigint, t double, old_u double, old_v double, new_u double, new_v double",
    )
    base, frames = E.move_point(base, frames, moves)
    assert sorted((r.point_idx, r.u) for r in base.collect()) == [(0, 21), (1, 22), (2, 87), (3, 102)]
    assert _points(frames)[0] == (0.1, 0, 23.0)


def test_add_and_delete_frames(spark):
    base, frames = _plate(spark, [1], [(0.3, [3]), (0.1, [4])])
    ask = spark.createDataFrame([(0, 5)], "plate_id bigint, seq bigint")
    _, more = E.add_keyframe(base, frames, ask)
    assert _points(more) == [(0.1, 0, 4), (0.3, 0, 3), (0.4, 0, 3)]
    _, first = E.add_keyframe(base, frames.limit(0), ask)
    assert _points(first) == [(0.1, 0, 1)]
    gone = spark.createDataFrame([(0, 0)], "plate_id bigint, kf_seq bigint")
    assert _points(E.delete_keyframe(frames, gone)) == [(0.1, 0, 4)]


def test_upsert_replaces_the_first_frame_of_that_time(spark):
    base, frames = _plate(spark, [1], [(0.2, [3]), (0.2, [4])])
    edits = spark.createDataFrame(
        [(0, 1, 0.2, 0, 7.0, 7.0), (0, 2, 0.2, 0, 8.0, 8.0), (0, 3, 0.0, 0, 9.0, 9.0), (0, 4, 0.5, 0, 6.0, 6.0)],
        "plate_id bigint, seq bigint, time double, point_idx int, u double, v double",
    )
    base, frames = E.upsert_keyframe(base, frames, edits)
    assert [r.u for r in base.collect()] == [9.0]
    assert sorted((r.kf_seq, r.time, r.u) for r in frames.collect()) == [(0, 0.2, 8.0), (1, 0.2, 4.0), (6, 0.5, 6.0)]


def test_moved_point_lands_in_a_new_frame(spark):
    base, frames = _plate(spark, [0, 10], [(0.2, [4, 10])])
    move = spark.createDataFrame(
        [(0, 1, 0.1, 2.0, 2.0, 5.0, 6.0)],
        "plate_id bigint, seq bigint, t double, old_u double, old_v double, new_u double, new_v double",
    )
    # At 0.1, half way, the first point shows at 2.
    _, after = E.move_point(base, frames, move)
    assert _points(after) == [(0.1, 0, 5.0), (0.1, 1, 10.0), (0.2, 0, 4), (0.2, 1, 10)]


EVENT = "plate_id bigint, seq bigint, ts timestamp, u double, v double"


def test_stream_counts_every_edit(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    files = [
        [(2, 6, at(3, 2), 6.0, 6.0), (2, 8, at(5, 0), 8.0, 8.0)],
        [(1, 1, at(1, 1), 1.0, 1.0), (1, 2, at(1, 2), 2.0, 2.0), (2, 3, at(1, 5), 3.0, 3.0)],  # days late
        [(1, 7, at(1, 3), 7.0, 7.0)],
        [(1, 4, at(1, 9), 4.0, 4.0), (2, 5, at(3, 1), 5.0, 5.0)],
    ]

    def add(rows):
        df = spark.createDataFrame(rows, EVENT.replace("timestamp", "string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        ST.run_keyframe_stream(stream, out, checkpoint)
        return sorted(map(tuple, ST.read_keyframes(spark, out).collect()))

    batch = lambda: sorted(map(tuple, ST.keyframe_updates(spark.read.schema(EVENT).parquet(source)).collect()))
    for rows in files[:2]:
        add(rows)
    assert run() == batch()
    for rows in files[2:]:
        add(rows)
    assert run() == batch() and sum(r[-1] for r in batch()) == 8
    assert run() == batch()  # nothing new: nothing doubles
    # A batch that runs again replaces its own part.
    again = spark.read.parquet(f"{out}/batch_id=0")
    rows = [tuple(r) for r in again.collect()]
    spark.createDataFrame(rows, again.schema).write.mode("overwrite").parquet(f"{out}/batch_id=0")
    assert sorted(map(tuple, ST.read_keyframes(spark, out).collect())) == batch()


def test_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path):
    rows = [(i % 5, i, f"2024-01-{1 + i % 9:02d} 01:00:00", float(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(str(tmp_path / "a" / "edits.parquet"))
    df.toPandas().to_parquet(tmp_path / "edits.parquet", coerce_timestamps="us")
    for name, folder in (("folder", tmp_path / "a"), ("file", tmp_path)):
        stream = ST.edit_stream(spark, str(folder), "edits.parquet")
        ST.run_keyframe_stream(stream, str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"))
        assert ST.read_keyframes(spark, str(tmp_path / f"out-{name}")).agg(F.sum("n_edits")).first()[0] == 100



@pytest.mark.parametrize("unit,parts", [(1.0, 50), (3600.0, 50), (1e12, 64), (2.0**-40, 50), (1.0, 1 << 18)])
def test_bracket_in_any_unit_of_time(spark, unit, parts):
    rng = random.Random(6)
    frames = [(p, s, rng.randrange(300) * unit - 20 * unit) for p in (1, 1, 2) for s in range(200)]
    frames = sorted({(p, s): t for p, s, t in frames}.items())
    frames = [(p, s, t) for (p, s), t in frames]
    asked = [(p, rng.randrange(-40, 620) * unit / 2) for p in (1, 2, 3) for _ in range(150)]
    got = K.bracket_frames(
        spark.createDataFrame(frames, "plate_id long, kf_seq long, time double"), spark.createDataFrame(asked, "plate_id long, t double"), parts
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [(t, s) for p, s, t in frames if p == r.plate_id]
        lower = max((f for f in own if f[0] <= r.t), default=(0.0, -1))
        after = min((t for t, _ in own if t >= r.t), default=None)
        upper = lower if after is None else max(f for f in own if f[0] == after)
        assert (r.lower_time, r.lower_seq, r.upper_time, r.upper_seq) == (*lower, *upper)


def test_parts_of_a_hot_plate_are_bounded(spark):
    """A million frames within a millionth of the time, all of one plate but a few."""
    crowd = spark.range(1_000_000).select(
        F.lit(1).cast("long").alias("plate_id"), (F.col("id") / 2.0**41).alias("t"), F.col("id").alias("f")
    )
    rows = crowd.unionByName(spark.range(50).select(F.col("id").alias("plate_id"), F.lit(5e9).alias("t"), F.col("id").alias("f")))
    cut = cut_by_counts(rows, ["plate_id"], ["t"], 50_000)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert sum(sizes) == 1_000_050 and max(sizes) < 3 * 50_000 and len(sizes) > 10


def test_frames_meet_appended_points_by_cells(spark):
    frames = spark.createDataFrame([(p, s, s / 10, 2) for p in (0, 1) for s in range(7)], "plate_id bigint, kf_seq bigint, time double, n bigint")
    placed = spark.createDataFrame([(0, at, float(at), 0.0) for at in range(11)] + [(2, 0, 0.0, 0.0)], "plate_id bigint, _at bigint, u double, v double")
    got = sorted((r.plate_id, r.kf_seq, r._at, r.u, r.n) for r in E._crossed(frames, placed, cell_rows=3).collect())
    assert got == [(0, s, at, float(at), 2) for s in range(7) for at in range(11)]


def test_a_move_looks_into_every_frame(spark):
    points = spark.createDataFrame([(0, -1, 3, 1.0, 1.0), (0, -1, 2, 1.0, 1.0), (0, 5, 4, 1.0, 1.0), (0, 6, 0, 1.0, 2.0), (1, 5, 0, 1.0, 1.0)], "plate_id bigint, kf_seq bigint, point_idx int, u double, v double")
    moves = spark.createDataFrame([(0, 1.0, 1.0, 7.0, 8.0), (0, None, 1.0, 7.0, 9.0)], "plate_id bigint, old_u double, old_v double, new_u double, new_v double")
    got = sorted(tuple(r) for r in E.find_moved_point(points, moves, within=("kf_seq",)).select("plate_id", "kf_seq", "new_v", "point_idx").collect())
    assert got == [(0, -1, 8.0, 2), (0, 5, 8.0, 4)]


@pytest.mark.parametrize("mode", ["extreme", "bracket"])
def test_times_of_a_hot_plate_are_split(spark, mode):
    """Half of all times ask for the same two frames of one plate."""
    base, frames = _plate(spark, [1, 2], [(0.2, [3, 4, 5]), (0.9, [6, 7, 8])])
    asked = _ask(spark, [0.3 + i / 2000 for i in range(1000)]).unionByName(_ask(spark, [0.5, None], 3)).unionByName(_ask(spark, [0.3]))
    whole = sorted(tuple(r) for r in K.interpolate(base, frames, asked, mode, share=1).collect())
    parted = sorted(tuple(r) for r in K.interpolate(base, frames, asked, mode, share=50).collect())
    assert whole == parted and len(whole) == 3000
    assert all(abs(u - (3 + i + 3 * (t - 0.2) / 0.7)) < 1e-9 for _, t, i, u, _ in whole)
