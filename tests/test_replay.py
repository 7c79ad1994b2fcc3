"""The edit log against a plain loop over lists."""

import random

import pytest
from pyspark.sql import functions as F

from platefield.operators import replay as R
from platefield.streaming import replay as SR

BASE = "plate_id long, point_idx int, u double, v double"
FRAMES = "plate_id long, kf_seq long, time double, point_idx int, u double, v double"
LOG = "plate_id long, seq long, op string, kf_seq long, point_idx int, time double, u double, v double"


def plain(base, frames, log):
    pts = {}
    for p, i, u, v in sorted(base):
        pts.setdefault(p, []).append([u, v])
    own = {}
    for p, kf, time, i, u, v in sorted(frames):
        own.setdefault(p, {}).setdefault(kf, [time, []])[1].append([u, v])
    top = {p: max(f) for p, f in own.items()}
    for p, seq, op, kf, idx, time, u, v in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[1])):
        points, fs = pts.setdefault(p, []), own.setdefault(p, {})
        lists = [points, *[f[1] for f in fs.values()]]
        if op == "append":
            for each in lists:
                each.append([u, v])
        elif op == "delete" and idx is not None and 0 <= idx < len(points):
            for each in lists:
                del each[idx]
        elif op == "move":
            each = points if kf is None else fs[kf][1] if kf in fs else []
            if idx is not None and 0 <= idx < len(each):
                each[idx] = [each[idx][0] if u is None else u, each[idx][1] if v is None else v]
        elif op == "add":
            fs[top.get(p, -1) + 1 + seq] = [time, [list(q) for q in points]]
        elif op == "retime" and kf in fs:
            fs[kf][0] = time
        elif op == "drop":
            fs.pop(kf, None)
    return (
        sorted((p, i, u, v) for p, points in pts.items() for i, (u, v) in enumerate(points)),
        sorted((p, kf, f[0], i, u, v) for p, fs in own.items() for kf, f in fs.items() for i, (u, v) in enumerate(f[1])),
    )


def replayed(spark, base, frames, log, **sizes):
    done = R.replay(spark.createDataFrame(base, BASE), spark.createDataFrame(frames, FRAMES), spark.createDataFrame(log, LOG), **sizes)
    return tuple(sorted(map(tuple, df.collect())) for df in done)


def random_log(rng, plates, edits, ops):
    base, frames, log = [], [], []
    for p in plates:
        n = rng.randrange(4)
        base += [(p, i, rng.random(), rng.random()) for i in range(n)]
        frames += [(p, kf, rng.random(), i, rng.random(), rng.random()) for kf in range(rng.randrange(3)) for i in range(n)]
    added = {}
    tops = {p: max((f[1] for f in frames if f[0] == p), default=-1) for p in plates}
    for seq in range(edits):
        p = rng.choice(plates[:1] * 2 + plates)
        op = rng.choice(ops)
        if op == "add":
            added.setdefault(p, []).append(tops[p] + 1 + seq)
        kf = rng.choice([None, None, 0, 1, 7, *added.get(p, [])[-3:]])
        coordinates = [None if op == "move" and rng.random() < 0.2 else rng.random() for _ in "uv"]
        idx = rng.choice([0, 0, 1, 2, 3, 5, 9, 40, -1, None])
        log.append((p, seq, op, kf, idx, rng.random(), *coordinates))
    rng.shuffle(log)
    return base, frames, log


ALL = ["append", "append", "delete", "move", "move", "add", "retime", "drop", None, "paint"]


@pytest.mark.parametrize("seed,chunk", [(1, 10), (3, 1 << 14)])
def test_replay_equals_plain_loop(spark, seed, chunk):
    rng = random.Random(seed)
    base, frames, log = random_log(rng, [1, 2, 5, 9], 200, ALL)
    log += [(None, 5, "append", None, None, None, 0.5, 0.5), (77, 1, "append", None, None, None, 0.1, 0.2), (78, 1, "add", None, None, 0.5, None, None)]
    assert replayed(spark, base, frames, log, chunk=chunk) == plain(base, frames, log)


def test_frames_that_the_log_added_are_edited(spark):
    base = [(1, 0, 0.1, 0.2)]
    log = [
        (1, 10, "add", None, None, 0.5, None, None), (1, 11, "move", 10, 0, None, 0.9, None), (1, 12, "append", None, None, None, 0.3, 0.3),
        (1, 13, "move", None, 0, None, 0.7, 0.7), (1, 14, "move", 10, 1, None, None, 0.6), (1, 15, "retime", 10, None, 0.25, None, None),
        (1, 9, "move", 10, 0, None, 0.0, 0.0), (1, 16, "add", None, None, 0.75, None, None), (1, 17, "drop", 16, None, None, None, None),
    ]
    got = replayed(spark, base, [], log)
    assert got == plain(base, [], log)
    assert got[1] == [(1, 10, 0.25, 0, 0.9, 0.2), (1, 10, 0.25, 1, 0.3, 0.6)]


def test_deletes_and_appends_in_turn_over_many_chunks(spark):
    rng = random.Random(8)
    base = [(1, i, float(i), 0.0) for i in range(3)]
    log = []
    for seq in range(900):
        op = ("append", "delete")[seq % 2] if seq % 60 < 40 else rng.choice(["delete", "delete", "append"])
        log.append((1, seq, op, None, rng.choice([0, 1, 2, 3, 10, 30]), None, float(seq), 0.5))
    assert replayed(spark, base, [], log, chunk=32) == plain(base, [], log)


def test_length_functions_of_neighbours_compose():
    rng = random.Random(4)
    for _ in range(500):
        f, edits = R._Lengths(), []
        for _ in range(rng.randrange(30)):
            edits.append(rng.choice([-1, rng.randrange(12)]))
            f.append() if edits[-1] < 0 else f.delete(edits[-1])
        for n in range(20):
            m = n
            for e in edits:
                m = m + 1 if e < 0 else m - (m > e)
            assert m == n + f.constant - sum(t <= n for t in f.thresholds)


def test_replay_of_nothing(spark):
    assert replayed(spark, [], [], []) == ([], [])
    base, frames = [(1, 0, 0.5, 0.5)], [(1, 0, 0.1, 0, 0.2, 0.3)]
    assert replayed(spark, base, frames, []) == (base, frames)


def test_no_task_has_a_hot_plate(spark):
    """A plate with all edits is cut into chunks, and each chunk is one key."""
    log = spark.range(4000).select(
        F.lit(1).cast("long").alias("plate_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "delete").otherwise("append").alias("op"),
        F.lit(None).cast("long").alias("kf_seq"), (F.col("id") % 50).cast("int").alias("point_idx"),
        F.lit(0.5).alias("u"), F.lit(0.5).alias("v"),
    )
    sizes = spark.createDataFrame([(1, 5)], "plate_id long, n long")
    named = R.named_points(sizes, log, chunk=100)
    deleted = [r.point_id for r in named.where("op = 'delete' AND point_id IS NOT NULL").collect()]
    assert len(set(deleted)) == len(deleted) > 1000


def stream_log(spark, folder):
    return spark.readStream.schema(LOG + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_plain_loop_after_each_restart(spark, tmp_path, shuffled):
    rng = random.Random(12)
    base, frames, log = random_log(rng, [1, 2, 5], 120, ALL)
    log.sort(key=lambda r: r[1])
    files = [log[i : i + 25] for i in range(0, len(log), 25)]
    if shuffled:
        # The third file, an hour and more behind the last one, comes at the end.
        files.append(files.pop(2))
    state = (spark.createDataFrame(base, BASE), spark.createDataFrame(frames, FRAMES))
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    sofar = []
    for i, part in enumerate(files):
        rows = spark.createDataFrame(part, LOG)
        rows.selectExpr("*", f"CAST(timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, seq * 2, 0) AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(folder)
        sofar += part
        # A new query each time, which goes on from the checkpoint.
        SR.run_replay_stream(stream_log(spark, folder), *state, out, checkpoint, delay="10 minutes")
        got = SR.read_state(spark, out)
        touched = {r[0] for r in sofar}
        want = plain([b for b in base if b[0] in touched], [f for f in frames if f[0] in touched], sofar)
        assert tuple(sorted(map(tuple, df.collect())) for df in got) == want
    late = [(r.plate_id, r.seq) for r in SR.read_late(spark, out).collect()]
    counts = SR.late_counts(spark, out).collect()
    assert sum(r.n_edits for r in counts) == len(log) and sum(r.n_late for r in counts) == len(late)
    assert sorted(late) == (sorted((r[0], r[1]) for r in files[-1]) if shuffled else [])


def test_neighbours_share_a_key_of_the_stream(spark, tmp_path):
    """Python is called for 64 plates at once, and whole numbers stay whole on their way."""
    far = 2**53 + 1
    plates = [*range(-5, 0), *range(190), 10**15]
    base = [(p, i, p + 0.1, float(i)) for p in plates for i in range(2)]
    frames = [(p, far + p, 0.5, i, 0.1 * i, p + 0.2) for p in plates for i in range(2)]
    log = [(p, 3, "move", far + p, 1, None, float("inf"), None) for p in plates]
    log += [(p, 7, "append", None, None, None, 1e-7, p + 0.3) for p in plates[::2]] + [(500, 1, "add", None, None, 0.5, None, None)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    rows = spark.createDataFrame([*log, (3, 9, "move", None, 0, None, float("nan"), 0.25)], LOG)
    rows.selectExpr("*", "timestamp'2024-01-01' AS ts").coalesce(1).write.parquet(folder)
    states = (spark.createDataFrame(base, BASE), spark.createDataFrame(frames, FRAMES))
    query = SR.run_replay_stream(stream_log(spark, folder), *states, out, checkpoint)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 6
    log.append((3, 9, "move", None, 0, None, None, 0.25))
    assert tuple(sorted(map(tuple, df.collect())) for df in SR.read_state(spark, out)) == plain(base, frames, log)
