"""Ordered-row operators against plain loops, on small and on widely spread order values."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platefield.operators import generate as G
from platefield.operators import sequence as Q
from platefield.operators import boxes as boxes_module
from platefield.operators.boxes import box_from_corners, box_intersects
from platefield.operators.ranking import SEQ_BITS, running_total, with_position


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(4)
    spread = lambda n: sorted(rnd.sample(range(1 << 39), n))
    return {1: spread(300), 2: list(range(1 << 20, (1 << 20) + 17)), 3: [0], 4: spread(7)}


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, s, float(s % 97)) for k, seqs in groups.items() for s in seqs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k int, seq bigint, v double")


def test_positions(table, groups):
    got = {(r.k, r.seq): r.pos for r in with_position(table, ["k"], "seq").collect()}
    assert got == {(k, s): i for k, seqs in groups.items() for i, s in enumerate(seqs)}


def test_positions_of_any_bigint(spark):
    rnd = random.Random(8)
    seqs = sorted({rnd.randrange(-(1 << 63), 1 << 63) for _ in range(400)} | {-1, 0, 1, 1 << 40, 1 << 62, -(1 << 63), (1 << 63) - 1})
    df = spark.createDataFrame([(1, s) for s in rnd.sample(seqs, len(seqs))], "k int, seq bigint")
    assert {r.seq: r.pos for r in with_position(df, ["k"], "seq").collect()} == {s: i for i, s in enumerate(seqs)}
    zipped = Q.zip_all([df.withColumn(c, F.col("seq")) for c in "abc"], ["k"], "seq").collect()
    assert sorted(r.pos for r in zipped) == list(range(len(seqs))) and all(r.a == r.b == r.c for r in zipped)
    flat = Q.array_flat_map(df, ["k"], "seq", lambda i: F.array(i, -i), "item").collect()
    assert sorted(r["item"] for r in flat) == sorted([i for i in range(len(seqs))] + [-i for i in range(len(seqs))])
    folded = Q.ordered_fold(df, ["k"], "seq", F.col("seq").cast("string"), lambda a, b: F.concat(a, F.lit(","), b), initial=F.lit("start"))
    assert folded.first().result == ",".join(["start", *map(str, seqs)])


def test_running_total_over_all_levels(spark):
    rnd = random.Random(9)
    orders = sorted({rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)} | set(range(50)))
    df = spark.createDataFrame([(1, o, i % 7) for i, o in enumerate(orders)], "k int, o bigint, n bigint")
    got = {r.o: r.before for r in running_total(df, ["k"], "o", "n", SEQ_BITS).collect()}
    want, total = {}, 0
    for i, o in enumerate(orders):
        want[o] = total
        total += i % 7
    assert got == want


def test_null_keys_are_never_picked(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 2.0), (2, 1, None)], "k int, seq bigint, v double")
    seq = lambda pick: {r.k: r.seq for r in pick(df, ["k"], F.col("v"), "seq", ["seq"]).collect()}
    assert seq(Q.find_max) == seq(Q.get_lowest) == {1: 2} and seq(Q.find_min) == seq(Q.get_highest) == {1: 3}
    near = Q.nearest(df, ["k"], F.col("v"), F.lit(0.0), "seq", ["seq"]).collect()
    assert [(r.k, r.seq) for r in near] == [(1, 3)]


def test_distinct_first_of_texts_and_numbers(spark):
    df = spark.createDataFrame([(1, 2, "a", 1.0), (1, 1, "a", float("nan")), (1, 3, None, 1.0)], "k int, seq bigint, s string, x double")
    assert {(r.s, r.seq) for r in Q.distinct_first(df, ["k"], "s", "seq").collect()} == {("a", 1), (None, 3)}
    assert {(r.x, r.seq) for r in Q.distinct_first(df, ["k"], "x", "seq").collect()} == {(1.0, 2)}


def test_generators_are_dealt_over_the_cluster(spark):
    one = spark.range(1).select(F.lit(40).alias("n"), F.lit(1).alias("step"), F.lit(200_000).alias("many"), F.lit(0).alias("zero"))
    least = spark.sparkContext.defaultParallelism
    made = {
        "sphere": (G.gen_cube_sphere(one, "n"), 6 * 40 * 40 * 4),
        "uvs": (G.gen_equirect_uvs(one, "n"), 39 * 79 + 2),
        "pixels": (G.gen_pixel_grid(one, F.col("n"), F.col("n"), F.col("zero"), F.col("zero")), 1600),
        "range": (G.gen_range(one, "many", "step"), 200_000),
    }
    for name, (df, rows) in made.items():
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert df.rdd.getNumPartitions() >= least and sum(counts) == rows, name
        assert len(counts) >= (2 if name == "range" else least // 2), name
    assert G.gen_range(one, "zero", "step").count() == 0
    assert sorted(r.seq for r in G.gen_range(one, "many", "step").select("seq").collect()) == list(range(200_000))


@pytest.mark.parametrize("size,every", [(1, 1), (3, 1), (3, 2), (3, 3), (5, 2)])
def test_sliding_windows(table, groups, size, every):
    want = {}
    for k, seqs in groups.items():
        starts = [0] + list(range(1, len(seqs), every))
        for s in starts:
            if len(seqs[s : s + size]) == size:
                want[k, s] = seqs[s : s + size]
    got = Q.window_sliding_count(table, ["k"], "seq", ["v"], size, every).collect()
    assert {(r.k, r.start): [i.seq for i in r["items"]] for r in got} == want
    assert len(got) == len(want)


def test_sliding_windows_run_dry(table):
    with pytest.raises(ValueError):
        Q.window_sliding_count(table, ["k"], "seq", ["v"], 2, 3)


@pytest.mark.parametrize("size", [1, 4, 7])
def test_tumbling_windows(table, groups, size):
    got = Q.window_tumbling_count(table, ["k"], "seq", ["v"], size).collect()
    want = {(k, i): seqs[i * size : (i + 1) * size] for k, seqs in groups.items() for i in range(len(seqs) // size)}
    assert {(r.k, r.window): [i.seq for i in r["items"]] for r in got} == want


def test_array_parts(table, groups):
    got = Q.array_collect(table, ["k"], "seq", ["seq"], part_size=50).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.k, r.part)):
        assert len(r.seq) <= 50
        whole.setdefault(r.k, []).extend(r.seq)
    assert whole == groups


def test_zip_ends_with_the_shorter(table, groups):
    a = table.where("v > 30").select("k", "seq", F.col("seq").alias("a"))
    b = table.where("v <= 60").select("k", "seq", F.col("seq").alias("b"))
    want = set()
    for k, seqs in groups.items():
        want |= {(k, i, p, q) for i, (p, q) in enumerate(zip([s for s in seqs if s % 97 > 30], [s for s in seqs if s % 97 <= 60]))}
    assert {(r.k, r.pos, r.a, r.b) for r in Q.zip_rows(a, b, ["k"], "seq").collect()} == want


def test_ordered_fold_joins_text(table, groups):
    """Concatenation is associative but not commutative, so the order must hold."""
    lift = F.concat(F.col("seq").cast("string"), F.lit(";"))
    got = {r.k: r.result for r in Q.ordered_fold(table, ["k"], "seq", lift, F.concat).collect()}
    assert got == {k: "".join(f"{s};" for s in seqs) for k, seqs in groups.items()}


def test_ties(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 9), (1, 3, 2), (1, 4, 2)], "k int, seq bigint, v int")
    seq = lambda f, *a: f(rows, ["k"], F.col("v"), *a, "seq", ["seq"]).first().seq
    assert seq(Q.find_max) == 1 and seq(Q.find_min) == 3
    assert seq(Q.get_lowest) == 2 and seq(Q.get_highest) == 4
    assert seq(Q.nearest, F.lit(4)) == 0 and seq(Q.nearest, F.lit(10)) == 2


def test_empty_groups_of_values(spark):
    rows = spark.createDataFrame([(1, None)], "k int, v double")
    assert Q.agg_sum(rows, ["k"], F.col("v"), "s").first().s == 0.0
    assert Q.agg_average(rows, ["k"], F.col("v"), "m").first().m is None


def test_first_of_equal_values(spark):
    rows = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 9, float("nan")), (1, 2, 2.0)], "k int, seq bigint, v double")
    assert {(r.v, r.seq) for r in Q.distinct_first(rows, ["k"], "v", "seq").collect()} == {(1.0, 3), (2.0, 2)}


BOX = st.tuples(
    st.floats(-2, 2), st.floats(-2, 2),
    st.sampled_from([0.0, 1e-9, 0.01, 0.25, 0.5, 1.0, 3.7]), st.sampled_from([0.0, 1e-9, 0.01, 0.25, 0.5, 1.0, 3.7]),
)


@settings(max_examples=6, deadline=None)
@given(st.lists(BOX, min_size=1, max_size=25), st.lists(BOX, min_size=1, max_size=25))
def test_box_pairs(spark, left, right):
    frame = lambda boxes: spark.createDataFrame(
        [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(boxes)], "box_id bigint, x0 double, y0 double, x1 double, y1 double"
    )
    a, b = frame(left), frame(right)
    rows = lambda df: [tuple(r) for r in df.collect()]
    want = sorted(
        (i, j) for i, p, q, r, s in rows(a) for j, x, y, z, w in rows(b) if p <= z and r >= x and q <= w and s >= y
    )
    assert sorted(tuple(r) for r in box_intersects(a, b).collect()) == want


def test_boxes_far_away_wide_and_without_end(spark):
    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")

    def boxes(n):
        out = []
        for _ in range(n):
            x, y = (rng.choice([0.0, 1e8, 3e12, -5e15]) + rng.random() * rng.choice([1, 100]) for _ in "xy")
            w, h = (rng.choice([0.0, 2.0 ** rng.randrange(-20, 60)]) for _ in "xy")
            out.append([x, y, x + w, y + h])
        for i in (3, 7, 8):
            out[i][0], out[i][2] = -inf, rng.choice([inf, out[i][2]])
        out[5][3], out[9][0] = inf, nan
        return out

    left, right = boxes(40), boxes(60)
    schema = "box_id long, x0 double, y0 double, x1 double, y1 double"
    got = box_intersects(*[spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(side)], schema) for side in (left, right)])
    want = sorted(
        (i, j) for i, a in enumerate(left) for j, b in enumerate(right)
        if a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]
    )
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_points_far_away_have_cells_of_their_own(spark):
    points = spark.range(2000).select(
        F.col("id").alias("box_id"), *[(F.lit(1e8) + F.col("id") * 0.25).alias(c) for c in ("x0", "y0", "x1", "y1")]
    )
    sides = boxes_module._levels(points)
    probes = boxes_module._probes(sides, [(-25, -25)], [(-25, -25)], "left", True)
    assert probes.select("cx", "cy").distinct().count() == 2000
    assert box_intersects(points, points).count() == 2000


def test_a_small_box_is_in_a_grid_per_fourth_size_of_the_others(spark):
    sides = lambda w, h: [F.col("x0"), F.col("y0"), (F.col("x0") + w).alias("x1"), (F.col("y0") + h).alias("y1")]
    at = spark.range(1440).select(F.col("id").alias("box_id"), (F.col("id") * 37 % 101 / 101.0).alias("x0"), (F.col("id") * 41 % 103 / 103.0).alias("y0"))
    power = lambda step: F.pow(F.lit(2.0), -1.0 - F.col("box_id") % step)
    large = at.select("box_id", *sides(power(12), power(10)))
    small = at.where("box_id < 300").select("box_id", *sides(F.lit(0.0), F.lit(0.0)))
    levels = [boxes_module._levels(df) for df in (large, small)]
    pairs = [[(r.lx, r.ly) for r in df.select("lx", "ly").distinct().collect()] for df in levels]
    # Sides of 12 and of 10 sizes make 7 and 6 grids at most, as one may round up; a point is in one cell of each.
    assert boxes_module._probes(levels[1], pairs[1], pairs[0], "right", False).count() <= 300 * 42
    rows = [[tuple(r) for r in df.collect()] for df in (large, small)]
    want = sorted((i, j) for i, p, q, r, s in rows[0] for j, x, y, z, w in rows[1] if p <= z and r >= x and q <= w and s >= y)
    # Either table may be the larger one.
    assert sorted(map(tuple, box_intersects(large, small).collect())) == want
    assert sorted((r.right_id, r.left_id) for r in box_intersects(small, large).collect()) == want


def test_box_from_corners_in_any_order(spark):
    corners = spark.createDataFrame([(5.0, 9.0, 2.0, 11.0)], "ax double, ay double, bx double, by double")
    box = corners.select(*[c.alias(n) for n, c in box_from_corners(*map(F.col, ("ax", "ay", "bx", "by")), F.lit(1.0), F.lit(2.0)).items()])
    assert tuple(box.first()) == (1.0, 7.0, 4.0, 9.0)
