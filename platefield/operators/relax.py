"""Displacement of each node by its older or younger neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..session import cut_lineage

AXES = ("x", "y", "z")


def relax_directions(
    neighbors: DataFrame, nodes: DataFrame, rounds: int = 3, checkpoint_every: int = 4
) -> DataFrame:
    """``(plate_id, node_id, dx, dy, dz)`` after ``rounds`` synchronous rounds.

    In a round a node's direction becomes
    ``(own + sum over neighbours of (push + neighbour's direction)) / degree`` with
    ``push = (point - neighbour point) * max(0, age - neighbour age)``. The push
    does not change between rounds and is summed once; the first round starts from
    zero and needs no join. A node without neighbours has a NULL direction.

    ``nodes(plate_id, node_id, u, v, age)``, ``neighbors(plate_id, src, dst)``.
    """
    x, y, z = S.uv_to_xyz(F.col("u"), F.col("v"))
    points = nodes.select("plate_id", "node_id", x.alias("x"), y.alias("y"), z.alias("z"), "age")

    def end(role: str, name: str) -> DataFrame:
        return points.select(
            "plate_id", F.col("node_id").alias(role), *[F.col(c).alias(f"{name}{c}") for c in (*AXES, "age")]
        )

    pairs = neighbors.join(end("dst", "n"), ["plate_id", "dst"]).join(end("src", "p"), ["plate_id", "src"])
    weight = F.greatest(F.lit(0.0), F.col("page") - F.col("nage"))
    pushed = pairs.groupBy("plate_id", "src").agg(
        F.count(F.lit(1)).cast("double").alias("degree"),
        *[F.sum((F.col(f"p{c}") - F.col(f"n{c}")) * weight).alias(f"push_{c}") for c in AXES],
    )
    state = pushed.withColumnRenamed("src", "node_id").withColumns(
        {f"d{c}": F.col(f"push_{c}") / F.col("degree") if rounds else F.lit(0.0) for c in AXES}
    )
    for number in range(2, rounds + 1):
        told = (
            neighbors.join(
                state.select("plate_id", F.col("node_id").alias("dst"), *[f"d{c}" for c in AXES]),
                ["plate_id", "dst"],
            )
            .groupBy("plate_id", F.col("src").alias("node_id"))
            .agg(*[F.sum(f"d{c}").alias(f"in_{c}") for c in AXES])
        )
        state = state.join(told, ["plate_id", "node_id"]).select(
            "plate_id", "node_id", "degree", *[f"push_{c}" for c in AXES],
            *[
                ((F.col(f"d{c}") + F.col(f"push_{c}") + F.col(f"in_{c}")) / F.col("degree")).alias(f"d{c}")
                for c in AXES
            ],
        )
        if number % checkpoint_every == 0 and number < rounds:
            state = cut_lineage(state)
    return nodes.select("plate_id", "node_id").join(
        state.select("plate_id", "node_id", *[f"d{c}" for c in AXES]), ["plate_id", "node_id"], "left"
    )


def drop_zero_directions(directions: DataFrame) -> DataFrame:
    return directions.where("dx <> 0 or dy <> 0 or dz <> 0")


def displacement_segments(nodes: DataFrame, directions: DataFrame, height: int) -> DataFrame:
    """Arrow of each moved node, in pixels divided by the height.

    It ends where the point minus its direction projects to; an end off the sphere
    (|y| > 1) has no projection and is NULL.
    """
    joined = nodes.join(drop_zero_directions(directions), ["plate_id", "node_id"])
    px, py, pz = S.uv_to_xyz(F.col("u"), F.col("v"))
    moved = joined.withColumns({"ex": px - F.col("dx"), "ey": py - F.col("dy"), "ez": pz - F.col("dz")})
    eu, ev = S.xyz_to_uv(S.vec("e"))
    ended = moved.withColumns({"eu": eu, "ev": F.when(F.abs("ey") <= 1, ev)})
    x1, y1 = S.uv_to_pixel(F.col("u"), F.col("v"), height)
    x2, y2 = S.uv_to_pixel(F.col("eu"), F.col("ev"), height)
    h = float(height)
    return ended.select(
        "plate_id", "node_id",
        (x1 / h).alias("x1"), (y1 / h).alias("y1"), (x2 / h).alias("x2"), (y2 / h).alias("y2"),
    )
