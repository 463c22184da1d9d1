"""Options, text parsing and records that no table of the queries has."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera import options
from tessera.functions import geometry, records
from tessera.plans import registered
from tessera.sources import las, xyz


def test_options(spark):
    made = options.option("tiling", "test_only", 5)
    assert made.get(spark) == 5 and options.option("tiling", "test_only", 9) is made
    made.set(spark, 7)
    assert made.get(spark) == 7
    flag = options.option("sources", "test_flag", False)
    flag.set(spark, True)
    assert flag.get(spark) is True
    spark.conf.set(flag.key, "maybe")
    for bad in (lambda: made.set(spark, "7"), lambda: options.option("tiling", "test_only", "x"), lambda: options.option("other", "a", 1), lambda: options.option("tiling", "a b", 1), lambda: flag.get(spark)):
        with pytest.raises((TypeError, ValueError)):
            bad()
    for key in (made.key, flag.key):
        spark.conf.unset(key)


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.0 2.5 -3. more\n1 2.0 3.0\n1.0  2.0 3.0\n4.0 5.0 6.0\r\n\n. 1.0 2.0\n")
    got = sorted(map(tuple, xyz.read_strict(spark, f"file://{tmp_path}/a.txt").collect()))
    assert got == [(1.0, 2.5, -3.0), (4.0, 5.0, 6.0)]
    with pytest.raises(Exception, match="can't be parsed"):
        xyz.read_strict(spark, f"file://{tmp_path}/a.txt", 3).collect()


def test_binary_points(spark, tmp_path):
    df = spark.range(1000).selectExpr("double(id) x", "double(id) / 3 y", "if(id = 5, null, -double(id)) z").repartition(3)
    assert xyz.write_binary(df, f"file://{tmp_path}/b").agg(F.sum("n_points")).first()[0] == 1000
    got = xyz.read_binary(spark, f"file://{tmp_path}/b", 100)
    assert got.count() == 1000 and got.where("isnan(z)").count() == 1 and got.agg(F.sum("x")).first()[0] == 499500


def test_payloads():
    assert las.payload_items("keys", struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 7, 2049, 34737, 5, 3)) == [(0, "1024", 7.0, None), (1, "2049", 3.0, "34737:5")]
    assert las.payload_items("keys", b"") == [] and las.payload_items("doubles", b"123") == [] and las.payload_items("extra", bytes(100)) == []
    assert las.payload_items("text", b"a\0b") == [(0, None, None, "a")]


def test_degenerate_triangles_and_intervals(spark):
    line = [(F.lit(float(v)), F.lit(float(v))) for v in (0, 3, 6)]
    low = spark.range(1).select(*[v.alias(n) for v, n in zip(geometry.circle_extent(line), "abcd", strict=True)]).first()
    assert tuple(low) == pytest.approx((2.995, 2.995, 3.005, 3.005))
    five = (F.lit(5), F.lit(5))
    shift = records.interval_shift(five, five, 8)
    index, ratio = records.interval_map(F.lit(5), five, five, shift)
    assert tuple(spark.range(1).select(index.alias("i"), ratio.alias("r")).first()) == (0, 0.0)
    assert geometry.convex([(0, 0), (1, 0), (1, 1)]) and not geometry.convex([(0, 0), (1, 1)])
    star = spark.sql("select array(0d, 4d, 1d, 3d, 2d) x, array(0d, 1d, 4d, 0d, 5d) y, array(0d, 2d, 2d, 0d) u, array(0d, 0d, 2d, 2d) v, array(1d) w")
    assert tuple(star.select(geometry.convex_corners(F.col("x"), F.col("y")), geometry.convex_corners(F.col("u"), F.col("v")), geometry.convex_corners(F.col("w"), F.col("w"))).first()) == (False, True, False)


def test_sizes_beyond_the_last_unit(spark, tmp_path):
    """As the SQL of size_text: gigabytes are the last unit, however many there are."""
    n = F.lit(1025 << 30).cast("long")
    got = spark.range(1).select(geometry.byte_size(n, ("KB", "MB", "GB")).alias("a"), geometry.byte_size(n).alias("b"), geometry.byte_size(F.lit(7), ("KB",)).alias("c")).first()
    assert tuple(got) == ("1025.00 GB", "1.00 TB", "7 B")
    few = spark.createDataFrame([(3_300_000, 333_690, 1.0, None)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    few.write.parquet(f"{tmp_path}/orders.parquet")
    assert registered.QUERIES["size_text"](spark, str(tmp_path)).first().size == "1025.55 GB"


def test_z_order_past_ten_bits(spark, tmp_path):
    """From the 1025th column on tiles share the SQL's number of 10 bits: ties go by row and column, so turns don't vary."""
    placed = [(row, column) for row in range(3) for column in range(2600) if column % 1024 < 40]
    rows = [(i, column * 100, row * 50_000.0, None) for i, (row, column) in enumerate(reversed(placed))]
    orders = spark.createDataFrame([*rows, (10**6, 260_000, 150_000.0, None)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    orders.repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    number = lambda t: sum((t[1] >> b & 1) << 2 * b | (t[0] >> b & 1) << 2 * b + 1 for b in range(10))
    want = sorted([*placed, (2, 2599)], key=lambda t: (number(t), t))
    assert len({number(t) for t in want}) < len(want) / 2
    got = registered.QUERIES["tiles_in_z_order"](spark, str(tmp_path)).collect()
    assert [(r.tile_row, r.tile_col) for r in sorted(got, key=lambda r: r.turn)] == want
