"""The driver tables seen as plates, rasters, edits and boxes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..operators.raster import raster_sample

RASTER_HEIGHT = 100
RASTER_WIDTH = 2 * RASTER_HEIGHT
PLATE_POINTS = 50
DAY0_MICROS = 1704067200000000  # 2024-01-01
MONTH_MICROS = 2592000000000.0  # 30 days


def utc_instant(ts: str) -> Column:
    """Wall-clock times of a table as instants in UTC, whatever the session's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp")


def utc_day(ts: str) -> Column:
    """Day of an instant in UTC, as text."""
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(ts).cast("timestamp_ntz"))
    return F.date_format(wall, "yyyy-MM-dd")


class Tables:
    """Parquet tables of one folder, and the fixtures derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @cached_property
    def nodes(self) -> DataFrame:
        """50 embeddings make a plate; the first three components are a direction."""
        axes = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
        x, y, z = S.normalise(tuple(axes))
        plate = F.expr(f"vec_id div {PLATE_POINTS}")
        xyz = self.embeddings.select(
            plate.alias("plate_id"), (F.col("vec_id") % PLATE_POINTS).alias("node_id"),
            x.alias("x"), y.alias("y"), z.alias("z"),
        )
        u, v = S.xyz_to_uv(S.vec(""))
        return xyz.select("plate_id", "node_id", u.alias("u"), v.alias("v"))

    @cached_property
    def edits(self) -> DataFrame:
        """Every event as an edit; ``time`` runs from 0 to 1 over 30 days."""
        ts = utc_instant("ts")
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("user_id").alias("plate_id"),
            F.col("event_id").alias("seq"),
            ts.alias("ts"),
            F.col("event_type").alias("op"),
            ((F.unix_micros(ts) - DAY0_MICROS) / MONTH_MICROS).alias("time"),
            (F.col("value") / 500.0).alias("u"),
            (k / 100.0).alias("v"),
            F.col("value"),
            k.alias("k"),
        )

    @staticmethod
    def _two_points(edits: DataFrame, *columns) -> DataFrame:
        pair = F.array(
            F.struct(F.lit(0).alias("point_idx"), F.col("u"), F.col("v")),
            F.struct(F.lit(1).alias("point_idx"), F.col("v").alias("u"), F.col("u").alias("v")),
        )
        return edits.select(*columns, F.explode(pair).alias("p")).select(
            *[c if isinstance(c, str) else "kf_seq" for c in columns], "p.point_idx", "p.u", "p.v"
        )

    @cached_property
    def base(self) -> DataFrame:
        """The first event of a plate gives its two base points."""
        first = self.edits.groupBy("plate_id").agg(
            F.min_by("u", "seq").alias("u"), F.min_by("v", "seq").alias("v")
        )
        return self._two_points(first, "plate_id")

    @cached_property
    def keyframes(self) -> DataFrame:
        """Every event is a frame of two points."""
        return self._two_points(self.edits, "plate_id", F.col("seq").alias("kf_seq"), "time")

    def first_edit(self, op: str) -> DataFrame:
        """The first edit of one kind of each plate."""
        row = F.min_by(F.struct("seq", "time", "u", "v", "k"), "seq").alias("e")
        return self.edits.where(F.col("op") == op).groupBy("plate_id").agg(row).select("plate_id", "e.*")

    @cached_property
    def puts(self) -> DataFrame:
        """Every event writes one pixel."""
        channel = lambda c: (c % 256).cast("smallint")
        return self.edits.select(
            F.lit(0).alias("raster_id"), "seq",
            (F.col("plate_id") % RASTER_WIDTH).cast("int").alias("px"), F.col("k").alias("py"),
            channel(F.floor("value")).alias("r"), channel(F.col("k") * 2).alias("g"),
            channel(F.col("plate_id")).alias("b"), F.lit(255).cast("smallint").alias("a"),
        )

    @cached_property
    def raster(self) -> DataFrame:
        """What the writes leave, the last one on each pixel."""
        return self.puts.groupBy("raster_id", "px", "py").agg(
            *[F.max_by(c, "seq").alias(c) for c in "rgba"]
        )

    def with_age(self, nodes: DataFrame) -> DataFrame:
        """Age of each node: the red channel under it, over 256."""
        px, py = S.uv_to_pixel(F.col("u"), F.col("v"), RASTER_HEIGHT)
        placed = nodes.withColumns({"raster_id": F.lit(0), "px": px, "py": py})
        sampled = raster_sample(placed, self.raster, RASTER_WIDTH, RASTER_HEIGHT)
        return sampled.withColumn("age", F.col("r") / 256.0).select(*nodes.columns, "age")

    @cached_property
    def boxes(self) -> tuple[DataFrame, DataFrame]:
        """Selection boxes from parts, targets from orders."""
        corner = lambda key, a: (F.col(key) * a % 10007) / 10007.0
        parts = self.part.select(
            F.col("p_partkey").alias("box_id"),
            corner("p_partkey", 7919).alias("x0"), corner("p_partkey", 104729).alias("y0"),
            F.col("p_size") / 2000.0, F.col("p_retailprice") / 100000.0,
        ).toDF("box_id", "x0", "y0", "w", "h")
        targets = self.orders.select(
            F.col("o_orderkey").alias("box_id"),
            corner("o_orderkey", 7907).alias("x0"), corner("o_orderkey", 104723).alias("y0"),
            F.col("o_totalprice") / 100000000.0, (F.col("o_custkey") % 50) / 10000.0,
        ).toDF("box_id", "x0", "y0", "w", "h")
        sides = [F.col(c) for c in ("box_id", "x0", "y0")]
        done = lambda df: df.select(
            *sides, (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")
        )
        return done(parts), done(targets)
