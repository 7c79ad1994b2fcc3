"""Documents, backups, buffers and images."""

import json
import struct

from pyspark.sql import functions as F

from platefield.sources import images, plates


def test_documents_by_hand(spark):
    docs = [
        (0, json.dumps([{"points": [{"x": 0.1, "y": 0.2}], "timeline": [{"time": 0.5, "points": [{"x": 1, "y": 2}]}]}, {"points": []}])),
        (1, "not json"),
        (2, '[{"points": [{"x": 1'),
        (3, json.dumps([{"points": [{"x": 3, "y": 4}, {"x": 5, "y": 6}]}])),
    ]
    base, frames = plates.scan_plates_json(spark.createDataFrame(docs, "doc_id int, doc string"))
    assert sorted(map(tuple, base.collect())) == [(0, 0, 0, 0.1, 0.2), (3, 0, 0, 3.0, 4.0), (3, 0, 1, 5.0, 6.0)]
    assert [tuple(r) for r in frames.collect()] == [(0, 0, 0, 0.5, 0, 1.0, 2.0)]


def test_slices_round_trip(spark, tmp_path):
    base = spark.range(7).select(F.lit(4).cast("bigint").alias("plate_id"), F.col("id").cast("int").alias("point_idx"), (F.col("id") / 3).alias("u"), F.lit(0.1).alias("v"))
    frames = spark.range(35).select(
        F.lit(4).cast("bigint").alias("plate_id"), F.expr("id div 7").alias("kf_seq"), (F.expr("id div 7") / 10).alias("time"),
        (F.col("id") % 7).cast("int").alias("point_idx"), (F.col("id") / 9).alias("u"), F.lit(0.2).alias("v"),
    )
    docs = plates.plates_to_json(base, frames, slice_points=3, slice_frames=2)
    assert docs.count() == 3 * 3
    again = plates.scan_plates_json(docs.withColumnRenamed("plate_id", "doc_id"))
    for mine, theirs in zip((base, frames), again):
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.drop("doc_id").select(*mine.columns).collect()))
    path, backups = str(tmp_path / "plates"), str(tmp_path / "backups")
    plates.sink_plates_json(base, frames, path)
    plates.sink_plates_json(base, frames, path)
    first = plates.snapshot_backup(spark, path, backups, "2024-01-01T00-00-00Z")
    second = plates.snapshot_backup(spark, path, backups, "2024-01-02T00-00-00Z")
    assert first.count() == second.count() == 1
    assert spark.read.parquet(backups).count() == 2
    stamp = "2024-01-03T00:00:00Z"
    plates.snapshot_backup(spark, path, backups, stamp)
    assert plates.snapshot_backup(spark, path, backups, stamp).count() == 1 and spark.read.parquet(backups).count() == 3


def test_nothing_of_a_document_is_lost(spark):
    docs = [
        (0, json.dumps([{"points": []}, {"plate_id": 9, "points": None, "timeline": [{"time": 0.5, "points": []}, {"time": 0.7, "points": [{"x": 1, "y": 2}]}]}])),
        (1, ""), (2, None), (3, "[]"), (4, "{}"), (5, '[{"points": 5}]'), (6, '[{"points": [{"x": 1, "y": 2}]'), (7, '[], "x": []'), (8, "[{}]"),
    ]
    read = plates.scan_documents(spark.createDataFrame(docs, "doc_id int, doc string"))
    assert sorted(map(tuple, read.plates.collect())) == [(0, 0), (0, 9), (8, 0)]
    assert sorted(map(tuple, read.frames.collect())) == [(0, 9, 0, 0.5), (0, 9, 1, 0.7)]
    assert read.base.collect() == [] and [tuple(r) for r in read.keyframes.collect()] == [(0, 9, 1, 0.7, 0, 1.0, 2.0)]
    assert sorted(r.doc_id for r in read.broken.collect()) == [1, 4, 5, 6, 7]


def test_documents_of_bounded_bytes_with_uneven_frames(spark):
    """Frames of other lengths than their neighbours, empty ones and empty plates come back from small slices."""
    rows = [(p, f, f / 7, i, 1 / (i + 3), -1e-200 / 3) for p in (1, 2) for f in range(40) for i in range([0, 1, 30, 7][f % 4] * p)]
    frames = spark.createDataFrame(rows, "plate_id long, kf_seq long, time double, point_idx int, u double, v double")
    base = spark.createDataFrame([(1, i, 0.5, 0.25) for i in range(50)], "plate_id long, point_idx int, u double, v double")
    every = [(p, f, f / 7) for p in (1, 2, 5) for f in range(40)]
    named = spark.createDataFrame(every, "plate_id long, kf_seq long, time double")
    docs = plates.plates_to_json(
        base, frames, slice_points=16, slice_frames=64, slice_size=64, plates=spark.createDataFrame([(1,), (7,)], "plate_id long"), frames=named
    )
    assert docs.agg(F.max(F.octet_length("doc"))).first()[0] < 64 * (64 + 2 * 16) + 96 * 64
    read = plates.scan_documents(docs.select(F.lit(0).alias("doc_id"), "doc"))
    assert sorted(r.plate_id for r in read.plates.collect()) == [1, 2, 5, 7]
    assert sorted(tuple(r)[1:] for r in read.frames.collect()) == every
    assert sorted(tuple(r)[1:] for r in read.keyframes.collect()) == sorted(rows) and read.base.count() == 50
    assert read.broken.count() == 0


def test_bitmaps_written_by_spark(spark, tmp_path):
    rows = [(k, x, y, (x * 7 + y) % 256, 255 - x, y, 255) for k in (3, 8) for x in range(13) for y in range(5) if (x + y) % 4 or k == 3]
    raster = spark.createDataFrame(rows, "raster_id int, px int, py int, r int, g int, b int, a int")
    images.write_bitmaps(raster, str(tmp_path / "images"), 13, 5)
    found = images.scan_raster(spark, str(tmp_path / "images"), 13, 5).collect()
    got = {(int(r.origin.split("raster_id=")[1].split("/")[0]), r.px, r.py): (r.r, r.g, r.b, r.a) for r in found}
    own = {(k, x, y): (r, g, b, a) for k, x, y, r, g, b, a in rows}
    assert got == {(k, x, y): own.get((k, x, y), (0, 0, 0, 255)) for k in (3, 8) for x in range(13) for y in range(5)}


def test_buffers(spark):
    rows = spark.range(10).select(F.lit(1).alias("mesh_id"), F.col("id").alias("seq"), (F.col("id") / 3).alias("u"), (F.col("id") / 7).alias("v"))
    flat = plates.geometry_flatten(rows, ["mesh_id"], "seq", ["u", "v"], part_size=4)
    assert sorted(len(r.buffer) for r in flat.collect()) == [4, 8, 8]
    back = plates.geometry_unflatten(flat, ["mesh_id"], ["u", "v"], part_size=4)
    single = rows.withColumns({c: F.col(c).cast("float") for c in "uv"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, single.collect()))


def _bmp(path, rows):
    """A 24-bit bitmap; rows of (r, g, b), top first."""
    h, w = len(rows), len(rows[0])
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + pad for row in reversed(rows))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0)
    path.write_bytes(head + info + body)


def test_images(spark, tmp_path):
    image = [[(10 * x, y, 200 + x) for x in range(5)] for y in range(3)]
    _bmp(tmp_path / "a.bmp", image)
    (tmp_path / "broken.bmp").write_bytes(b"BM nothing")
    for w, h in ((5, 3), (10, 2), (2, 7)):
        got = {(r.px, r.py): (r.r, r.g, r.b, r.a) for r in images.scan_raster(spark, str(tmp_path), w, h).collect()}
        want = {
            (x, y): (*image[int((y + 0.5) * 3 / h)][int((x + 0.5) * 5 / w)], 255) for x in range(w) for y in range(h)
        }
        assert got == want
