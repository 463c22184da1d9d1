"""Registered queries of tiled storage, grid sizes and orders of tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import grid, tiled
from tessera.plans.catalogue import CELL, CELLS, DENSITY, LINE, LOW, PTS, SIDE, TILES, gridded, order_cells, query, tiles
from tessera.sources import points as src
from tessera.sources.scratch import scratch


#: Stores that this process has written, by application, tables and side: queries on one store write it once.
STORES: dict[tuple, str] = {}


def store(spark, d, side=SIDE) -> tiled.TiledPoints:
    key = spark.sparkContext.applicationId, d, side
    if key not in STORES:
        path = scratch(spark, "tiled")
        tiled.write_tiled(src.orders(spark, d), CELL, path, side)
        STORES[key] = path
    return tiled.open_tiled(spark, STORES[key])


@query(f"WITH {LOW} SELECT c.point_id, c.qx, c.qy, c.qz, c.tile_row, c.tile_col, l.point_id IS NOT NULL AS lowres FROM cells c LEFT JOIN low l ON l.point_id = c.point_id AND l.tile_row = c.tile_row AND l.tile_col = c.tile_col")
def tiled_write(spark, d):
    """All points of a store that was written and opened again."""
    return store(spark, d).points.select("point_id", "qx", "qy", "qz", "tile_row", "tile_col", "lowres")


@query(f"WITH {CELLS} SELECT point_id, x, y, z FROM cells WHERE tile_row BETWEEN 2 AND 3 AND tile_col BETWEEN 1 AND 4")
def tiled_read(spark, d):
    return store(spark, d).read((2, 3), (1, 4)).select("point_id", "x", "y", "z")


@query(f"WITH {TILES} SELECT * FROM tiles")
def tiled_reopen(spark, d):
    return store(spark, d).tiles


@query(f"""WITH {PTS}, f AS (SELECT min(qz) AS mn, max(qz) AS mx FROM pts), f2 AS (SELECT mn, mx, greatest(CASE WHEN mx > mn + 1 THEN length(bin(mx - mn - 1)) ELSE 0 END - 10, 0) AS s FROM f),
 c AS (SELECT (least((qz >> s) - (mn >> s), (mx - mn) >> s) + 0.5::DOUBLE) / (((mx - mn) >> s) + 1) * (mx - mn) + mn AS c FROM pts, f2), m AS (SELECT avg(c) AS mean FROM c),
 k AS (SELECT c, count(*) AS n FROM c GROUP BY 1)
 SELECT round(max(mean), 3) AS mean, round(sum((c - mean) * (c - mean)) / (count(*) - 1), 1) AS variance, (SELECT round(arg_max(c, (n, -c)), 3) FROM k) AS mode FROM c, m""")
def tiled_statistics(spark, d):
    return store(spark, d).statistics


@query(f"WITH {LOW} SELECT tile_row, tile_col, point_id FROM low")
def tiled_lowres(spark, d):
    return store(spark, d).lowres().select("tile_row", "tile_col", "point_id")


@query(f"WITH {TILES} SELECT tile_row, tile_col, row_number() OVER (ORDER BY point_offset, valid_index) AS turn FROM tiles")
def tile_read_order(spark, d):
    from tessera.operators.ordered import numbered

    return numbered(tiles(spark, d), ["point_offset", "valid_index"]).select("tile_row", "tile_col", (F.col("position") + 1).alias("turn"))


@query(f"WITH {TILES} SELECT t.tile_row, t.tile_col, c.point_id, t.valid_index FROM tiles t JOIN cells c USING (tile_row, tile_col)")
def tiled_scan(spark, d):
    """Every point with the ordinal of its tile, in the order of tiles."""
    s = store(spark, d)
    return s.points.join(s.tiles.select("tile_row", "tile_col", "valid_index"), ["tile_row", "tile_col"]).select("tile_row", "tile_col", "point_id", "valid_index").sortWithinPartitions("valid_index")


@query(f"WITH {CELLS} SELECT tile_row, tile_col, least((qy - mny - tile_row * csy) * 8 // csy, 7) AS py, least((qx - mnx - tile_col * csx) * 8 // csx, 7) AS px, max(qz) AS top, count(*) AS n FROM cells GROUP BY ALL")
def raster_tiles(spark, d):
    path = scratch(spark, "rasters")
    tiled.write_rasters(order_cells(spark, d), {"top": F.max("qz"), "n": F.count("*")}, path)
    return spark.read.parquet(path).drop("band")


@query(f"WITH {DENSITY} SELECT count(*) AS tiles, CAST(floor(sqrt(1000000.0::DOUBLE / count(*))) AS INTEGER) AS low_side, CAST(floor(sqrt(160000.0::DOUBLE / count(*))) AS INTEGER) AS far_side, CAST(floor(sqrt(list_sort(list(n))[count(*) // 2 + 1]) / 3) AS INTEGER) AS near_side FROM dens")
def detail_sizes(spark, d):
    s = grid.density_summary(grid.density(order_cells(spark, d)))
    far, near = grid.detail_sides(F.col("valid_tiles"), F.col("median_count"))
    return s.select(F.col("valid_tiles").alias("tiles"), grid.lowres_side(F.col("valid_tiles"), 1_000_000).alias("low_side"), far.alias("far_side"), near.alias("near_side"))


AREA = CELL[0] * CELL[1] * 0.01


@query(f"WITH {DENSITY}, s AS (SELECT count(*) AS k, list_sort(list(n)) AS l, sum(n) AS t, min(n) AS a, max(n) AS b FROM dens) SELECT round(a / {AREA}::DOUBLE, 12) AS min_density, round(b / {AREA}::DOUBLE, 12) AS max_density, round(l[k // 2 + 1] / {AREA}::DOUBLE, 12) AS median_density, round(CAST(t // k AS BIGINT) / {AREA}::DOUBLE, 12) AS mean_density FROM s")
def density_per_area(spark, d):
    s = grid.density_summary(grid.density(order_cells(spark, d)), AREA)
    return s.select(*[F.round(f"{k}_density", 12).alias(f"{k}_density") for k in ("min", "max", "median", "mean")])


@query(f"WITH {PTS}, e AS (SELECT max(x) - min(x) AS w, (max(y) - min(y)) / 100 AS h FROM pts) SELECT CASE WHEN w >= h THEN 1000 ELSE CAST(ceil(1000 * (w / h)) AS INTEGER) END AS n_cols, CASE WHEN w >= h THEN CAST(ceil(1000 / (w / h)) AS INTEGER) ELSE 1000 END AS n_rows FROM e")
def grid_by_dimension(spark, d):
    e = src.orders(spark, d).agg((F.max("x") - F.min("x")).alias("w"), ((F.max("y") - F.min("y")) / 100).alias("h"))
    columns, rows = grid.raster_size(F.col("w"), F.col("h"), 1000)
    return e.select(columns.alias("n_cols"), rows.alias("n_rows"))


@query(f"WITH {PTS} SELECT greatest(1, CAST(ceil((max(x) - min(x)) / 75.5::DOUBLE) AS BIGINT)) AS n_cols, greatest(1, CAST(ceil((max(y) - min(y)) / 30000.25::DOUBLE) AS BIGINT)) AS n_rows FROM pts")
def grid_by_cell_size(spark, d):
    return src.orders(spark, d).agg(grid.cells_for_size(F.min("x"), F.max("x"), 75.5).alias("n_cols"), grid.cells_for_size(F.min("y"), F.max("y"), 30000.25).alias("n_rows"))


@query(f"""WITH {DENSITY}, big AS (SELECT DISTINCT r, c, a, b, l, h FROM (SELECT tile_row * 100.0::DOUBLE AS a, (tile_row + 1) * 100.0::DOUBLE AS b, tile_col * 100.0::DOUBLE AS l, (tile_col + 1) * 100.0::DOUBLE AS h, tile_row AS r, tile_col AS c FROM dens)),
 fine AS (SELECT DISTINCT tile_row * 100 // 37 AS fr, tile_col * 100 // 37 AS fc FROM dens)
 SELECT r AS tile_row, c AS tile_col, fr AS fine_row, fc AS fine_col FROM big JOIN fine ON fr * 37.0::DOUBLE < b AND (fr + 1) * 37.0::DOUBLE > a AND fc * 37.0::DOUBLE < h AND (fc + 1) * 37.0::DOUBLE > l""")
def overlapping_cells(spark, d):
    """Tiles of side 100 and the cells of an unaligned grid of side 37 that they overlap, of those that aren't empty."""
    dens = grid.density(order_cells(spark, d)).select("tile_row", "tile_col")
    fine = dens.select(F.expr("tile_row * 100 div 37").alias("fine_row"), F.expr("tile_col * 100 div 37").alias("fine_col")).distinct()
    cover = lambda at: grid.covering_cells(F.col(at) * 100.0, (F.col(at) + 1) * 100.0, F.lit(0.0), 37.0)
    covered = dens.withColumn("fine_row", F.explode(cover("tile_row"))).withColumn("fine_col", F.explode(cover("tile_col")))
    return covered.join(fine, ["fine_row", "fine_col"], "left_semi").select("tile_row", "tile_col", "fine_row", "fine_col")


SEGMENTED = f"{DENSITY}, b AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM dens)"


@query(f"WITH {SEGMENTED} SELECT tile_row, tile_col, before // 1500 AS segment, before - min(before) OVER (PARTITION BY before // 1500) AS buffer_position FROM b")
def tile_segments(spark, d):
    return grid.in_segments(grid.density(order_cells(spark, d)), ["tile_row", "tile_col"], 1500).select("tile_row", "tile_col", "segment", "buffer_position")


@query("SELECT a.o_orderkey AS point_id, count(*) - 1 AS around FROM orders a JOIN orders b ON (a.o_custkey - b.o_custkey) * (a.o_custkey - b.o_custkey) + (a.o_totalprice - b.o_totalprice) * (a.o_totalprice - b.o_totalprice) <= 40000.0 GROUP BY a.o_orderkey")
def radius_count(spark, d):
    return grid.around(src.orders(spark, d), 200.0)


@query(f"WITH {DENSITY}, o AS (SELECT tile_row, tile_col, (tile_row - 5) * (tile_row - 5) + (tile_col - 5) * (tile_col - 5) AS d2 FROM dens) SELECT tile_row, tile_col, row_number() OVER (ORDER BY d2, tile_row, tile_col) - 1 AS position FROM o")
def tiles_by_distance(spark, d):
    from tessera.operators.ordered import numbered

    dr, dc = F.col("tile_row") - 5, F.col("tile_col") - 5
    placed = grid.density(order_cells(spark, d)).select("tile_row", "tile_col", (dr * dr + dc * dc).alias("d2"))
    return numbered(placed, ["d2", "tile_row", "tile_col"]).select("tile_row", "tile_col", "position")


MORTON = " + ".join(f"((tile_col >> {b}) & 1) * {1 << 2 * b} + ((tile_row >> {b}) & 1) * {2 << 2 * b}" for b in range(10))


@query(f"WITH {DENSITY} SELECT tile_row, tile_col, row_number() OVER (ORDER BY {MORTON}) - 1 AS turn FROM dens")
def tiles_in_z_order(spark, d):
    from tessera.operators.ordered import numbered

    placed = grid.density(order_cells(spark, d)).select("tile_row", "tile_col", grid.morton(F.col("tile_row"), F.col("tile_col"), 10).alias("z"))
    # Tiles beyond the 1024th row or column share a number with others: a full order, so that results don't vary.
    return numbered(placed, ["z", "tile_row", "tile_col"]).select("tile_row", "tile_col", F.col("position").alias("turn"))


@query(f"WITH {PTS}, m AS (SELECT count(*) / 4000.0::DOUBLE AS s FROM pts), k AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS i, greatest(1.0::DOUBLE, s) AS s FROM pts, m) SELECT point_id FROM k WHERE ceil(i / s) * s < i + 1")
def capped_points(spark, d):
    """At most 4000 points, evenly thinned."""
    from tessera.operators.ordered import numbered

    pts = numbered(src.orders(spark, d).select("point_id"), ["point_id"])
    step = grid.thinning_step(F.col("total"), 4000)
    return pts.where(F.ceil(F.col("position") / step) * step < F.col("position") + 1).select("point_id")


@query(f"WITH {LINE}, {gridded((50, 10))} SELECT DISTINCT (tile_row << 16) | tile_col AS tile_id, tile_row AS back_row, tile_col AS back_col FROM cells")
def tile_id_inverse(spark, d):
    pts = src.lineitems(spark, d)
    ids = grid.celled(pts, grid.grid(pts, 50, 10)).select(grid.packed_id(F.col("tile_row"), F.col("tile_col")).alias("tile_id")).distinct()
    row, column = grid.unpacked_id(F.col("tile_id"))
    return ids.select("tile_id", row.alias("back_row"), column.alias("back_col"))


@query(f"WITH {CELLS} SELECT point_id, round(pow((qx - mnx - tile_col * csx) / csx::DOUBLE - 0.5::DOUBLE, 2) + pow((qy - mny - tile_row * csy) / csy::DOUBLE - 0.5::DOUBLE, 2), 9) AS ratio FROM cells")
def ratio_to_centre(spark, d):
    """The squared distance of each point from the centre of its tile, as a share of the tile's size."""
    part = lambda q, low, at, cs: (F.col(q) - F.col(low) - F.col(at) * F.col(cs)) / F.col(cs).cast("double") - 0.5
    dx, dy = part("qx", "mnx", "tile_col", "csx"), part("qy", "mny", "tile_row", "csy")
    return order_cells(spark, d).select("point_id", F.round(F.pow(dx, F.lit(2)) + F.pow(dy, F.lit(2)), 9).alias("ratio"))
