"""Tiled storage: what a read opens, awkward tables; orders over a whole table."""

from pyspark.sql import functions as F

from tessera.operators import grid, ordered, tiled


def test_reads_are_pruned(spark, tmp_path):
    pts = spark.range(20_000).selectExpr("id point_id", "double(id % 200) x", "double(id div 200) y", "double(id % 7) z", "id % 200 qx", "id div 200 qy", "id % 7 qz")
    tiled.write_tiled(pts, (10, 10), f"file://{tmp_path}/s", 2)
    store = tiled.open_tiled(spark, f"file://{tmp_path}/s")
    some = store.read((4, 5), (0, 1))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "PushedFilters: [IsNotNull(tile_row)" in plan and "GreaterThanOrEqual(tile_row,4)" in plan
    assert some.select(F.input_file_name().alias("f")).distinct().where("f like '%band=1%'").count() == some.select(F.input_file_name().alias("f")).distinct().count()
    assert some.count() == 400 and store.lowres().count() + store.main().count() == 20_000
    assert store.lowres().count() == store.tiles.agg(F.sum("lowres_count")).first()[0]
    ends = store.read_order().collect()
    assert [t.point_offset for t in ends] == sorted(t.point_offset for t in ends)


def test_repeated_ids(spark, tmp_path):
    """Each sub-cell has one low-resolution point, however many rows share its id, place and height."""
    pts = spark.range(4000).selectExpr("id % 40 point_id", "double(id % 20) x", "double(id div 20 % 20) y", "double(id % 3) z", "id % 20 qx", "id div 20 % 20 qy", "id % 3 qz")
    tiled.write_tiled(pts.union(pts), (10, 10), f"file://{tmp_path}/r", 2)
    store = tiled.open_tiled(spark, f"file://{tmp_path}/r")
    low = store.lowres().groupBy("tile_row", "tile_col").count().collect()
    assert [r["count"] for r in low] == [4] * 4 and store.points.count() == 8000
    assert store.tiles.agg(F.sum("lowres_count"), F.sum("point_count")).first()[:] == (16, 8000)


def test_empty_store(spark, tmp_path):
    none = spark.sql("select 1L point_id, 1d x, 1d y, 1d z, 1L qx, 1L qy, 1L qz where false")
    tiled.write_tiled(none, (10, 10), f"file://{tmp_path}/s")
    store = tiled.open_tiled(spark, f"file://{tmp_path}/s")
    assert store.points.count() == store.tiles.count() == 0


def test_running_sums_and_numbers(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(5)
    order = sorted(rows)
    got = sorted(ordered.running_sums(df, ["k"], {"before": F.col("n"), "twice": F.col("n") * 2}).collect())
    assert got == [(k, n, i, sum(v for _, v in order[:i]), 2 * sum(v for _, v in order[:i])) for i, (k, n) in enumerate(order)]
    assert sorted((r.k, r.position, r.total) for r in ordered.numbered(df, ["k"]).collect()) == [(k, i, 101) for i, (k, _) in enumerate(order)]
    assert ordered.running_sums(df.where("false"), ["k"], {"before": F.col("n")}).count() == 0


def test_orders_of_tables_with_any_names(spark):
    """Columns called as those that are added are replaced, others stay whatever their names; a choice of columns is kept."""
    df = spark.createDataFrame([(k, k, "a", "b", 5, 6, 7) for k in (3, 1, 2)], "k int, n int, part string, mark string, position int, total int, first int")
    got = sorted((r.k, r.position, r.total, r.part, r.mark, r.first) for r in ordered.numbered(df, ["k"]).select("k", "position", "total", "part", "mark", "first").collect())
    assert got == [(1, 0, 3, "a", "b", 7), (2, 1, 3, "a", "b", 7), (3, 2, 3, "a", "b", 7)]
    sums = ordered.running_sums(df, ["k"], {"total": F.col("n")})
    assert sorted((r.k, r.position, r.total) for r in sums.collect()) == [(1, 0, 0), (2, 1, 1), (3, 2, 3)]
    assert ordered.numbered(df, ["k"], ["part"]).columns == ["part", "total", "position"]


def test_scratch_of_a_block(spark):
    """What a block writes is gone behind it, what it writes elsewhere stays, and the usual folder is back."""
    from tessera.sources import scratch

    usual = scratch.session_dir(spark)
    with scratch.apart(spark) as outer:
        inside = scratch.written(spark.range(3).toDF("i"), "inside")
        kept = scratch.written(inside, "kept", f"{outer}/stay")
        assert scratch.session_dir(spark) != usual and outer == usual
    assert scratch.session_dir(spark) == usual and kept.count() == 3
    try:
        gone = inside.count() == 0
    except Exception:
        gone = True
    assert gone


def test_budgets_on_ties(spark):
    tiles = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 1)], "t int, n long")
    assert sorted(r.t for r in grid.within_budget(tiles, ["t"], 10).collect()) == [0, 1]
    parts = {r.t: (r.segment, r.buffer_position) for r in grid.in_segments(tiles, ["t"], 10).collect()}
    assert parts == {0: (0, 0), 1: (0, 5), 2: (1, 0), 3: (1, 5)}
