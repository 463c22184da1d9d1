"""The LAS data source: round trips, what filters leave unread, tiled sets, handlers, and a stream of files."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import las, lasformat
from tessera.sources.points import Quantization

Q = Quantization((1.0, 1.0, 1.0))


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(5000).selectExpr("int(id % 100) qx", "int(id div 100) qy", "int(id * 7 % 31) qz", "double(id) gps_time", "int(id % 32) class_bits")


def test_round_trip_by_format(spark, points, tmp_path):
    lasformat.register(spark)
    folder = f"file://{tmp_path}/a"
    points.repartition(3).write.format("las").option("scale", "1,1,1").mode("overwrite").save(folder)
    got = spark.read.format("las").option("fields", "gps_time,x,qy,classification,nir").load(folder)
    assert sorted(map(tuple, got.collect())) == [(float(i), float(i % 100), i // 100, i % 32, None) for i in range(5000)]
    points.limit(10).write.format("las").mode("append").option("scale", "1,1,1").save(folder)
    assert spark.read.format("las").load(folder).count() == 5010
    points.limit(10).write.format("las").mode("overwrite").option("scale", "1,1,1").save(folder)
    assert spark.read.format("las").load(folder).count() == 10
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_temporary")]
    with pytest.raises(Exception, match="missing"):
        points.drop("qz").write.format("las").mode("append").save(folder)


def test_a_failed_write_leaves_nothing(spark, points, tmp_path):
    lasformat.register(spark)
    folder = f"file://{tmp_path}/b"
    bad = points.withColumn("qz", F.when(F.col("gps_time") == 4321, F.raise_error(F.lit("stop"))).otherwise(F.col("qz")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        bad.repartition(3).write.format("las").mode("append").save(folder)
    assert not list((tmp_path / "b").iterdir()) if (tmp_path / "b").exists() else True


def test_filters_reach_the_files(spark, points, tmp_path):
    folder = f"file://{tmp_path}/c"
    lasformat.write_tiled_las(points, (10, 10), folder, Q)
    df = spark.read.format("las").option("fields", "qx,qy,gps_time,tile_row,tile_col").load(folder)
    some = df.where("tile_row = 2 and tile_col >= 3 and tile_col < 5 and qx > 31")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # What the source compares itself is gone from the plan; only tests for null are left.
    assert "BatchScan las" in plan and "isnotnull" in plan and " = 2" not in plan and " > 31" not in plan and " >= 3" not in plan
    assert sorted(map(tuple, some.select("qx", "qy").collect())) == sorted((x, y) for x in range(32, 50) for y in range(20, 30))
    reader = lasformat.LasReader(folder, df.schema)
    every = len(reader.partitions())
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not

    left = list(reader.pushFilters([EqualTo(("tile_row",), 2), GreaterThan(("x",), 1e9), Not(EqualTo(("qx",), 1))]))
    assert [type(f).__name__ for f in left] == ["Not"] and reader.partitions()[0].head == {}
    reader = lasformat.LasReader(folder, df.schema)
    assert not list(reader.pushFilters([EqualTo(("tile_row",), 2)])) and len(reader.partitions()) == every // 5
    assert df.where("gps_time is null").count() == 0 and df.where("nullif(qx, 5) is null").count() == 50


def test_tiled_set(spark, points, tmp_path):
    folder = f"file://{tmp_path}/d"
    lasformat.write_tiled_las(points, (10, 10), folder, Q)
    tiles = lasformat.tile_set(spark, folder)
    rows = tiles.groupBy("tile_row", "tile_col").agg(F.sum("point_count").alias("n"), F.min("point_offset").alias("o")).orderBy("tile_row", "tile_col").collect()
    assert sum(r.n for r in rows) == 5000 and [r.o for r in rows] == sorted(r.o for r in rows)
    _, _, facts = lasformat.set_records(folder)
    assert facts["points"] == 5000 and facts["density"]["valid_tiles"] == len(rows) and facts["max_xyz"][0] == 99.0 and facts["grid"]["csx"] == 10
    head = lasformat.head_of(f"{folder}/{lasformat.SET_FILE}")
    assert head["n_points"] == 0 and head["n_evlrs"] == 2 and head["max_xyz"] == [99.0, 49.0, 30.0]
    assert las.read_las(spark, [f"file://{p}" for p in (tmp_path / "d").glob("part*.las")]).count() == 5000
    lasformat.write_tiled_las(points.where("false"), (10, 10), f"file://{tmp_path}/e", Q)
    assert lasformat.tile_set(spark, f"file://{tmp_path}/e").count() == 0
    assert spark.read.format("las").load(f"file://{tmp_path}/e").count() == 0


def test_handlers(spark, points, tmp_path):
    (tmp_path / "p.xyz").write_text("1.0 2.0 3.0\nbad\n4.5 5.5 6.5\n")
    assert lasformat.open_points(spark, f"file://{tmp_path}/p.xyz").count() == 2
    lasformat.register(spark)
    points.coalesce(1).write.format("las").mode("overwrite").option("scale", "1,1,1").save(f"file://{tmp_path}/f")
    (file,) = (tmp_path / "f").glob("*.las")
    assert lasformat.open_points(spark, f"file://{file}").count() == 5000
    (tmp_path / "all.lasgroup").write_text(f"f/{file.name}\n")
    assert lasformat.open_points(spark, f"file://{tmp_path}/all.lasgroup").count() == 5000
    assert lasformat.supported() == [".las", ".lasgroup", ".laz", ".txt", ".xyz"]
    with pytest.raises(ValueError, match="no handler"):
        lasformat.open_points(spark, "a.e57")


def test_stream_of_files(spark, points, tmp_path):
    """Files that come between two runs are counted once; a third run without new ones adds nothing."""
    lasformat.register(spark)
    folder, state = f"file://{tmp_path}/g", f"file://{tmp_path}/state"
    points.repartition(2).write.format("las").mode("append").save(folder)
    assert lasformat.stream_counts(spark, folder, state).agg(F.sum("n")).first()[0] == 5000
    points.limit(70).coalesce(1).write.format("las").mode("append").save(folder)
    for _ in range(2):
        found = lasformat.stream_counts(spark, folder, state)
        assert found.agg(F.sum("n"), F.count("*")).first()[:] == (5070, 3)
