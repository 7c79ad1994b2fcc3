"""A log of mixed edits, replayed into the state of all plates.

``log(plate_id, seq, op, kf_seq, point_idx, time, u, v)`` holds, per plate in order of its unique ``seq``:

========  ==========================================================================
append    (u, v) becomes the last point of the base and of every frame
delete    point ``point_idx`` goes from the base and every frame; later ones move down
move      point ``point_idx`` of frame ``kf_seq`` (NULL: of the base) goes to (u, v);
          a NULL coordinate stays as it is, so this also sets a single one
add       a frame at ``time`` copies the base as it is then; its key is the plate's greatest
          first key + 1 + ``seq``
retime    frame ``kf_seq`` gets ``time``
drop      frame ``kf_seq`` goes
========  ==========================================================================

An edit that names no present point or frame changes nothing, nor does another ``op`` or a NULL one.
Rows without a plate are left out. The frames of the first state have the points of the base.

How it scales. No plate is replayed in one task. What depends on order is only which point an
index means, as deletes move the later ones. A log is cut into chunks of ``CHUNK`` edits:

1. The number of points behind a chunk is a function of that before it: n plus a constant, less one for
   each of some thresholds that n reaches. Functions of neighbouring chunks are put together,
   which gives the number of points before each.
2. In its chunk an index becomes a place in the list before the chunk, or an appended point.
3. Neighbouring chunks merge in rounds: a place before the right one becomes a place before the
   left one by counting the left one's deletes up to it. Rounds are as many as the logarithm of the chunks of
   the longest log: none if every log fits a chunk.

With points named for good, all else is keyed: the last write of a coordinate counts,
and a copied frame looks up the base as of its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import carried, cut_by_counts
from .edits import BASE_COLUMNS, FRAME_COLUMNS
from .ranking import SEQ_BITS, running_total, with_position

#: Edits of one chunk, and frames of a plate that meet its points in one group.
CHUNK, FRAME_BLOCK = 1 << 14, 1 << 10
#: Before every edit.
START = -(1 << 62)


def _above(keys: list[int], value: int) -> int:
    """How many of the thresholds ``keys``, less their place in the list, are at most ``value``."""
    lo, hi = 0, len(keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if keys[mid] - mid <= value:
            lo = mid + 1
        else:
            hi = mid
    return lo


class _Lengths:
    """The number of points after some edits, as a function of the number n before them."""

    def __init__(self) -> None:
        # n + constant - how many of the thresholds, which rise, are at most n.
        self.constant, self.thresholds = 0, []

    def append(self) -> None:
        self.constant += 1

    def delete(self, idx: int) -> None:
        """One point less for every n that leaves more than ``idx`` points."""
        rest = idx + 1 - self.constant
        if rest <= 0:
            self.constant -= 1
        else:
            k = _above(self.thresholds, rest)
            self.thresholds.insert(k, rest + k)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, tuple, pd.DataFrame]]:
    """(first of its chunk, (plate, chunk), rows) of sorted rows, batch by batch."""
    last = None
    for rows in batches:
        for key, some in rows.groupby(["plate_id", "chunk"], sort=False):
            yield key != last, key, some
            last = key


SUMMARY = "plate_id long, chunk long, constant long, thresholds array<long>"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The length function of each chunk, with the thresholds that can matter."""
    held = None

    def done():
        (plate, chunk), f, low, high = held
        # The plate has more than ``low`` and at most ``high`` points, so thresholds elsewhere are settled.
        reached = sum(t <= low for t in f.thresholds)
        open_ = [t for t in f.thresholds if low < t <= high]
        return pd.DataFrame([(plate, chunk, f.constant - reached, open_)], columns=["plate_id", "chunk", "constant", "thresholds"])

    for fresh, key, rows in _runs(batches):
        if fresh:
            if held:
                yield done()
            first = rows.iloc[0]
            held = (key, _Lengths(), int(first["low"]), int(first["high"]))
        f = held[1]
        for op, idx in zip(rows["op"], rows["point_idx"]):
            if op == "append":
                f.append()
            elif op == "delete":
                f.delete(int(idx))
    if held:
        yield done()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of points before each chunk of a plate; one small row per chunk, in order."""
    plate, n = None, 0
    for rows in batches:
        starts = []
        for p, n0, constant, thresholds in zip(rows["plate_id"], rows["n0"], rows["constant"], rows["thresholds"]):
            if p != plate:
                plate, n = p, n0
            starts.append(n)
            n += constant - sum(t <= n for t in thresholds)
        yield pd.DataFrame({"plate_id": rows["plate_id"], "chunk": rows["chunk"], "n_start": starts})


NAMED = "plate_id long, seq long, chunk long, op string, kf_seq long, u double, v double, place long, point_id long"


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each index means: a place in the list before the chunk, or an appended point.

    One pass over sorted rows; most chunks are a whole short log, so nothing is built per chunk.
    """
    key = None
    start = next_id = appended = 0
    gone: list[int] = []
    for rows in batches:
        places, ids = [], []
        columns = [rows[c].tolist() for c in ("plate_id", "chunk", "op", "point_idx", "n_start", "n0", "appended")]
        for plate, chunk, op, idx, n_start, n0, before in zip(*columns):
            if (plate, chunk) != key:
                key, gone, appended = (plate, chunk), [], 0
                start, next_id = int(n_start), int(n0 + before)
            at = -1
            if op == "append":
                at = start + appended
                appended += 1
            elif idx is not None and idx == idx and idx >= 0:  # not NULL
                k = _above(gone, int(idx))
                at = int(idx) + k
                if at >= start + appended:
                    at = -1
                elif op == "delete":
                    gone.insert(k, at)
            places.append(None if at < 0 or at >= start else at)
            ids.append(next_id + at - start if at >= start else None)
        out = rows[["plate_id", "seq", "chunk", "op", "kf_seq", "u", "v"]].astype({"kf_seq": "Int64"})
        yield out.assign(place=pd.array(places, dtype="Int64"), point_id=pd.array(ids, dtype="Int64"))


def _chunks(edits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per chunk: n0, what was appended before it, and the number of points at its start."""
    counts = edits.groupBy("plate_id", "chunk").agg(
        F.count_if(F.col("op") == "append").alias("a"), F.count_if(F.col("op") == "delete").alias("d")
    )
    before = Window.partitionBy("plate_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    n0 = F.coalesce("n", F.lit(0)).cast("long")
    chunks = cut_lineage(
        counts.select("plate_id", "chunk", sofar("a").alias("appended"), sofar("d").alias("deleted"))
        .join(sizes, "plate_id", "left").withColumn("n0", n0).drop("n")
    )
    several = chunks.where("chunk > 0").select("plate_id").distinct()
    bounded = chunks.join(several, "plate_id", "left_semi").select(
        "plate_id", "chunk", "n0", (F.greatest(F.col("n0") + F.col("appended") - F.col("deleted"), F.lit(0))).alias("low"),
        (F.col("n0") + F.col("appended")).alias("high"),
    )
    met = edits.where("op <> 'move' AND (op = 'append' OR point_idx >= 0)").join(bounded.drop("n0"), ["plate_id", "chunk"]).select(
        "plate_id", "chunk", "seq", "op", "point_idx", "low", "high"
    )
    order = ["plate_id", "chunk", "seq"]
    summaries = met.repartition("plate_id", "chunk").sortWithinPartitions(*order).mapInPandas(_summaries, SUMMARY)
    # A chunk of moves alone has no summary; it changes no number.
    whole = bounded.join(summaries, ["plate_id", "chunk"], "left").select(
        "plate_id", "chunk", "n0", F.coalesce("constant", F.lit(0)).alias("constant"),
        F.coalesce("thresholds", F.array().cast("array<long>")).alias("thresholds"),
    )
    starts = whole.repartition("plate_id").sortWithinPartitions("plate_id", "chunk").mapInPandas(
        _chain, "plate_id long, chunk long, n_start long"
    )
    return cut_lineage(chunks.join(starts, ["plate_id", "chunk"], "left").select(
        "plate_id", "chunk", "n0", "appended", F.coalesce("n_start", "n0").alias("n_start")
    ))


def _merged(named: DataFrame, chunks: DataFrame, level: int) -> DataFrame:
    """Places before a right group of 2^level chunks as places before its left neighbour, or as points appended there."""
    group = F.shiftright("chunk", level)
    first = chunks.where(F.col("chunk") % (1 << level) == 0).select(
        "plate_id", F.shiftright("chunk", level).alias("_left"), "n_start", (F.col("n0") + F.col("appended")).alias("_next")
    ).where("_left % 2 = 0")
    rows = named.withColumn("_group", group)
    # All that the left group deletes, in places of its list: the one before it, then what it appends.
    gone = rows.where("op = 'delete' AND _group % 2 = 0 AND (place IS NOT NULL OR point_id IS NOT NULL)").withColumnRenamed("_group", "_left")
    gone = gone.join(first, ["plate_id", "_left"]).select(
        "plate_id", "_left", F.coalesce("place", F.col("n_start") + F.col("point_id") - F.col("_next")).alias("at")
    )
    # The k-th of them in order stands before all places from at - k on.
    steps = with_position(gone, ["plate_id", "_left"], "at", "_k").select(
        "plate_id", "_left", (F.col("at") - F.col("_k")).alias("place"), F.lit(1).cast("long").alias("_n")
    )
    open_ = rows.where("_group % 2 = 1 AND place IS NOT NULL").withColumn("_left", F.col("_group") - 1)
    asked = open_.select("plate_id", "_left", "place").distinct().withColumn("_n", F.lit(0).cast("long"))
    keys = ["plate_id", "_left"]
    counts = steps.unionByName(asked).groupBy(*keys, "place").agg(F.sum("_n").alias("_n"))
    passed = running_total(counts, keys, "place", "_n", SEQ_BITS).select(*keys, "place", (F.col("before") + F.col("_n")).alias("_gone"))
    moved = open_.join(passed, [*keys, "place"]).join(first, keys).withColumn("_at", F.col("place") + F.col("_gone"))
    inner = F.col("_at") < F.col("n_start")
    moved = moved.withColumns({
        "point_id": F.when(~inner, F.col("_next") + F.col("_at") - F.col("n_start")),
        "place": F.when(inner, F.col("_at")),
    }).select(*named.columns)
    rest = rows.where("NOT (_group % 2 = 1 AND place IS NOT NULL)").select(*named.columns)
    return rest.unionByName(moved)


def named_points(sizes: DataFrame, log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Appends, deletes and moves with the ``point_id`` that each means, NULL if none.

    The points of the first state, ``sizes(plate_id, n)``, are 0 to n-1; appended ones follow.
    """
    wanted = log.where("plate_id IS NOT NULL AND op IN ('append', 'delete', 'move')").select(
        "plate_id", "seq", "op", "kf_seq", F.col("point_idx").cast("long").alias("point_idx"), "u", "v"
    )
    edits = cut_lineage(
        with_position(cut_lineage(wanted), ["plate_id"], "seq", "_pos").withColumn("chunk", F.expr(f"_pos div {chunk}")).drop("_pos")
    )
    chunks = _chunks(edits, sizes)
    order = ["plate_id", "chunk", "seq"]
    named = cut_lineage(
        edits.join(chunks, ["plate_id", "chunk"]).repartition("plate_id", "chunk").sortWithinPartitions(*order)
        .mapInPandas(_places, NAMED)
    )
    longest = chunks.agg(F.max("chunk")).first()[0] or 0
    for level in range(longest.bit_length()):
        named = cut_lineage(_merged(named, chunks, level))
    return named.withColumn("point_id", F.coalesce("point_id", "place")).drop("place", "chunk")


def replay(base: DataFrame, keyframes: DataFrame, log: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(base_point, keyframe)`` after all edits of ``log``."""
    base, keyframes = base.select(*BASE_COLUMNS), keyframes.select(*FRAME_COLUMNS)
    log = log.where("plate_id IS NOT NULL")
    sizes = base.groupBy("plate_id").agg(F.count(F.lit(1)).alias("n"))
    named = named_points(sizes, log, chunk)
    here = ["plate_id", "point_id"]

    born = cut_lineage(
        base.select("plate_id", F.col("point_idx").cast("long").alias("point_id"), F.lit(START).alias("seq"), "u", "v")
        .unionByName(named.where("op = 'append'").select(*here, "seq", "u", "v"))
    )
    gone = named.where("op = 'delete' AND point_id IS NOT NULL").select(*here).distinct()
    points = cut_lineage(
        with_position(born.join(gone, here, "left_anti"), ["plate_id"], "point_id", "_at")
        .withColumn("point_idx", F.col("_at").cast("int")).drop("_at")
    )
    moves = cut_lineage(named.where("op = 'move' AND point_id IS NOT NULL").join(points.select(*here), here, "left_semi"))
    on_base = moves.where("kf_seq IS NULL").select(*here, "seq", "u", "v")
    writes = points.select(*here, "seq", "u", "v").unionByName(on_base)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    new_base = writes.groupBy(*here).agg(last("u"), last("v")).join(points.select(*here, "point_idx"), here).select(*BASE_COLUMNS)

    frames = _frames(keyframes, log)
    cells = _cells(frames, points)
    first = F.col("_since") == START
    # Frames of the first state have its points; copies look the base up as of their time.
    kept = cells.where(first).join(
        keyframes.select("plate_id", "kf_seq", F.col("point_idx").cast("long").alias("point_id"), F.col("u").alias("_u"), F.col("v").alias("_v")),
        ["plate_id", "kf_seq", "point_id"], "left",
    ).where(F.col("_u").isNotNull() | F.col("_v").isNotNull() | (F.col("_born") > START))
    asked = cells.where(~first).select("plate_id", "point_id", "kf_seq", F.col("_since").alias("seq"))
    blank = F.lit(None).cast("double")
    merged = writes.withColumn("kf_seq", F.lit(None).cast("long")).unionByName(asked.withColumns({"u": blank, "v": blank}))
    seen = carried(cut_by_counts(merged, here, ["seq", "kf_seq"]), here, ["seq", "kf_seq"], {"_u": "u", "_v": "v"}).where("kf_seq IS NOT NULL")
    copied = cells.where(~first).join(seen.select("plate_id", "kf_seq", "point_id", "_u", "_v"), ["plate_id", "kf_seq", "point_id"])
    later = moves.where("kf_seq IS NOT NULL").join(frames.select("plate_id", "kf_seq", "_since"), ["plate_id", "kf_seq"]).where(
        "seq > _since"
    ).groupBy("plate_id", "kf_seq", "point_id").agg(last("u"), last("v"))
    done = kept.unionByName(copied).join(later, ["plate_id", "kf_seq", "point_id"], "left")
    value = lambda c: F.coalesce(c, f"_{c}", f"_{c}0").alias(c)
    return new_base, done.select("plate_id", "kf_seq", "time", "point_idx", value("u"), value("v"))


def _frames(keyframes: DataFrame, log: DataFrame) -> DataFrame:
    """Frames that are there in the end: plate_id, kf_seq, time, and since when."""
    old = keyframes.groupBy("plate_id", "kf_seq").agg(F.first("time").alias("time")).withColumn("_since", F.lit(START))
    top = keyframes.groupBy("plate_id").agg(F.max("kf_seq").alias("top"))
    key = F.coalesce("top", F.lit(-1)) + 1 + F.col("seq")
    new = log.where("op = 'add'").join(top, "plate_id", "left").select("plate_id", key.alias("kf_seq"), "time", F.col("seq").alias("_since"))
    # One row per frame that is named, whatever the number of edits.
    named = log.where("op IN ('retime', 'drop') AND kf_seq IS NOT NULL").groupBy("plate_id", "kf_seq").agg(
        F.max(F.when(F.col("op") == "drop", F.col("seq"))).alias("_dropped"),
        F.max(F.when(F.col("op") == "retime", F.struct("seq", F.col("time").alias("_time")))).alias("_set"),
    )
    met = old.unionByName(new).join(named, ["plate_id", "kf_seq"], "left").where("_dropped IS NULL OR _dropped < _since")
    return cut_lineage(met.select(
        "plate_id", "kf_seq", F.when(F.col("_set.seq") > F.col("_since"), F.col("_set._time")).otherwise(F.col("time")).alias("time"), "_since"
    ))


def _cells(frames: DataFrame, points: DataFrame) -> DataFrame:
    """Every frame with every point of its plate, in groups of FRAME_BLOCK frames."""
    blocks = with_position(frames, ["plate_id"], "kf_seq", "_at").withColumn("_block", F.expr(f"_at div {FRAME_BLOCK}")).drop("_at")
    used = blocks.groupBy("plate_id").agg(F.max("_block").alias("_most"))
    dealt = points.join(used, "plate_id").select(
        "plate_id", "point_id", "point_idx", F.col("seq").alias("_born"), F.col("u").alias("_u0"), F.col("v").alias("_v0"),
        F.explode(F.sequence(F.lit(0).cast("long"), "_most")).alias("_block"),
    )
    return cut_lineage(blocks.join(dealt, ["plate_id", "_block"]).drop("_block"))
