"""Files of points: LAS headers and records, text lines with and without numbers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import registered
from tessera.sources import las, laz, xyz
from tessera.sources.points import Quantization


def test_las_ranges_and_negative_coordinates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(las, "RANGE", 100)
    rows = spark.range(1050).selectExpr("int(id - 500) qx", "int(-id) qy", "int(7) qz", "if(id = 3, null, double(id)) gps_time").repartition(3)
    folder = f"file://{tmp_path}"
    written = las.write_las(rows, folder, Quantization((0.5, 1.0, 2.0), (10.0, 0.0, 0.0))).collect()
    assert sum(r.n_points for r in written) == 1050
    got = sorted((r.qx, r.qy, r.x, r.z, r.gps_time) for r in las.read_las(spark, folder).collect())
    assert got == sorted((i - 500, -i, (i - 500) * 0.5 + 10, 14.0, 0.0 if i == 3 else float(i)) for i in range(1050))
    assert {tuple(h.scale) for h in las.headers(spark, folder).collect()} == {(0.5, 1.0, 2.0)}


def test_old_las_without_time(spark, tmp_path):
    rows = np.zeros(5, las.RECORDS[0])
    rows["qx"], rows["intensity"] = range(5), 9
    head = bytearray(las.header_of(rows, Quantization()))[:227]
    struct.pack_into("<BB", head, 24, 1, 2)
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 5)
    (tmp_path / "old.las").write_bytes(bytes(head) + rows.tobytes())
    got = las.read_las(spark, f"file://{tmp_path}").orderBy("point_index").collect()
    assert [(r.qx, r.intensity, r.gps_time) for r in got] == [(i, 9, None) for i in range(5)]
    assert las.headers(spark, f"file://{tmp_path}").first().version == "1.2"


def test_broken_las_is_an_error(spark, tmp_path):
    (tmp_path / "bad.las").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no LAS file"):
        las.headers(spark, f"file://{tmp_path}").collect()


def test_compressed_and_newer_formats(spark, tmp_path):
    rows = np.zeros(2, las.RECORDS[1])
    rows["qx"], rows["options"] = (4, 5), 9
    head = bytearray(las.header_of(rows, Quantization()))
    (tmp_path / "new.las").write_bytes(bytes(head) + rows.tobytes())
    head[104] = 0x81
    (tmp_path / "new.las").write_bytes(bytes(head) + rows.tobytes())
    with pytest.raises(Exception, match="compressed"):
        las.headers(spark, f"file://{tmp_path}").collect()


def test_no_points_write_no_file(spark, tmp_path):
    none = spark.sql("select int(1) qx, int(1) qy, int(1) qz, 1d gps_time where false")
    assert las.write_las(none, f"file://{tmp_path}/x", Quantization()).collect() == []


def test_xyz_lines(spark):
    lines = spark.createDataFrame([("1 2.5 -3 9",), ("a 1, 2",), (None,), ("",), ("p=1.;q=2;r=3.25",)], "value string")
    got = [(r.x, r.y, r.z, r.bad) for r in xyz.parsed_lines(lines).collect()]
    assert got == [(1.0, 2.5, -3.0, False), (None, None, None, True), (None, None, None, True), (None, None, None, True), (1.0, 2.0, 3.25, False)]
    assert xyz.parsed_lines(lines, signed=False).first().z == 3.0


@pytest.mark.parametrize("form", range(11))
def test_every_point_format(spark, tmp_path, form):
    """All fields of all formats survive; a record longer than its format is skipped over; fields are decoded as asked for."""
    wide = form >= 6
    df = spark.range(50).selectExpr(
        "int(id - 20) qx", "int(-id) qy", "int(id * 3) qz", "int(id + 60000) intensity", "int(id % 5 + 1 + 16 * 7) options" if wide else "int(id % 5 + 1 + 8 * 5 + 64 + 128) options", "int(64 + 128) flags", "int(id % 30) classification",
        "int(id % 30 + 32) class_bits", "int(-id) scan_angle", "int(id) user_data", "int(id + 65000) source_id", "double(id) / 4 gps_time", "int(id * 1000) red", "int(id * 2) green", "int(id) blue", "int(id * 7) nir",
    )
    folder = f"file://{tmp_path}/f"
    las.write_las(df.repartition(2), folder, Quantization((0.5, 1.0, 1.0)), form, [("me", 7, "a record", b"abc"), ("LASF_Spec", 4, "", b"")], [("you", 9, "more", bytes(70_000))]).collect()
    have = dict(las.RECORDS[form])
    fields = ["qx", "x", "intensity", "return_number", "return_count", "scan_direction", "flight_edge", "classification", "scan_angle", "user_data", "source_id", "gps_time", "red", "nir"]
    got = sorted(tuple(r) for r in las.read_las(spark, folder, fields).collect())
    want = [(i - 20, (i - 20) * 0.5, i + 60000, i % 5 + 1, 7 if wide else 5, 1, 1, i % 30, -i, i, i + 65000, i / 4 if "gps_time" in have else None, i * 1000 if "red" in have else None, i * 7 if "nir" in have else None) for i in range(50)]
    assert got == want
    kept = {(r.extended, r.user_id, r.record_id, r.description, len(r.data), r.known) for r in las.records(spark, folder).collect()}
    assert kept == {(0, "me", 7, "a record", 3, None), (0, "LASF_Spec", 4, "", 0, "extra bytes"), (1, "you", 9, "more", 70_000, None)}
    one = las.merged(las.headers(spark, folder)).first()
    assert one.n_points == 50 and one.kinds == 1 and one.by_return[:6] == [10, 10, 10, 10, 10, 0] and one.min_xyz[1] == -49
    offset = las.headers(spark, folder).select(las.rgb_offset(F.col("point_format")).alias("at")).first().at
    assert offset == {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}.get(form)


def test_list_files_and_ranges(spark, tmp_path):
    """A list names files relative to itself, lists among them; missing files are skipped. Ranges read single points."""
    for name in ("a", "b"):
        las.write_las(spark.range(30).selectExpr("int(id) qx", "int(0) qy", "int(0) qz").coalesce(1), f"file://{tmp_path}/{name}", Quantization()).collect()
    (tmp_path / "inner.lasgroup").write_text("b/part-000000-0000.las\nmissing.las\ninner.lasgroup\n")
    (tmp_path / "all.lasgroup").write_text("a/part-000000-0000.las\n\ninner.lasgroup\n")
    both = f"file://{tmp_path}/all.lasgroup"
    assert las.read_las(spark, both).count() == 60
    some = las.headers(spark, both).selectExpr("path", "7L start", "2L n")
    found = las.read_las(spark, both, ("qx", "byte_offset"), some).collect()
    assert sorted((r.qx, r.byte_offset) for r in found) == [(q, 375 + 28 * q) for q in (7, 7, 8, 8)]
    assert {r.line for r in las.preview(spark, both).collect()} == {"LAS 1.4, format 1, 30 points, x 0.00 to 0.29 y 0.00 to 0.00 z 0.00 to 0.00"}


def test_runs_of_points_go_on_in_the_next_file(spark, monkeypatch, tmp_path):
    """Files that are shorter than a run: positions are those in all files, as in the SQL of las_sparse_scan."""
    n = 4000
    spark.range(n).selectExpr("id o_orderkey", "id * 7 % 1000 o_custkey", "1.5D o_totalprice", "timestamp'1996-01-02' o_orderdate").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(las, "FILE", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = sorted(map(tuple, registered.QUERIES["las_sparse_scan"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, i * 7 % 1000) for i in range(n) if i // 512 in (1, 2, 5)]


def test_ranges_are_dealt_to_tasks_by_their_points(spark, monkeypatch, tmp_path):
    """Adaptive execution doesn't put the ranges of all files into one task."""
    df = spark.range(8000).selectExpr("id qx", "id qy", "id qz", "double(id) gps_time").repartition(4)
    las.write_las(df, f"file://{tmp_path}/a", Quantization()).collect()
    monkeypatch.setattr(las, "RANGE", 500)
    got = las.read_las(spark, f"file://{tmp_path}/a", ("qx",)).select("qx", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"), F.min("qx")).collect()
    assert sum(r.n for r in got) == 8000 and len(got) > 8 and max(r.n for r in got) <= 1500
    laz.write_laz(df, f"file://{tmp_path}/b", Quantization(), 1, 250).collect()
    monkeypatch.setattr(laz, "CHUNK", 1000)
    got = laz.read_laz(spark, f"file://{tmp_path}/b", ("qx",)).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in got) == 8000 and len(got) >= 6
