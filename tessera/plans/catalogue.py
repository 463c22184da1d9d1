"""The registered queries of the point-cloud operators with their SQL equivalents, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quantize, records
from tessera.operators import grid, segments, surface, tiled
from tessera.sources import las, xyz
from tessera.sources import points as src
from tessera.sources.scratch import scratch
from tessera.streaming.density import stream_density

QUERIES: dict = {}
SQL: dict[str, str] = {}

CELL = (100, 5_000_000)  # of orders: customers, hundredths of a price
CHUNK = 500
SIDE = 4
LEVELS = 5

DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
PTS = f"""pts AS (SELECT o_orderkey AS point_id, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, CAST({DAY} AS DOUBLE) AS z,
  CAST(o_custkey AS BIGINT) AS qx, CAST(trunc(o_totalprice / 0.01) AS BIGINT) AS qy, CAST({DAY} AS BIGINT) AS qz FROM orders)"""
CUST = """pts AS (SELECT c_custkey AS point_id, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS z,
  CAST(c_custkey AS BIGINT) AS qx, CAST(trunc(c_acctbal / 0.01) AS BIGINT) AS qy, CAST(c_nationkey AS BIGINT) AS qz FROM customer)"""
LINE = """pts AS (SELECT l_orderkey AS point_id, CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, l_extendedprice AS z,
  CAST(l_partkey AS BIGINT) AS qx, CAST(l_suppkey AS BIGINT) AS qy, CAST(trunc(l_extendedprice / 0.01) AS BIGINT) AS qz FROM lineitem)"""


def gridded(cell: tuple[int, int]) -> str:
    return f"""g AS (SELECT min(qx) AS mnx, max(qx) AS mxx, min(qy) AS mny, max(qy) AS mxy, {cell[0]} AS csx, {cell[1]} AS csy,
  greatest(1, CAST(ceil((max(qx) - min(qx)) / {cell[0]}) AS BIGINT)) AS n_cols, greatest(1, CAST(ceil((max(qy) - min(qy)) / {cell[1]}) AS BIGINT)) AS n_rows FROM pts),
cells AS (SELECT pts.*, g.*, least((qy - mny) // csy, n_rows - 1) AS tile_row, least((qx - mnx) // csx, n_cols - 1) AS tile_col FROM pts, g)"""


CELLS = f"{PTS}, {gridded(CELL)}"
DENSITY = f"{CELLS}, dens AS (SELECT tile_row, tile_col, count(*) AS n, min(qz) AS min_qz, max(qz) AS max_qz FROM cells GROUP BY ALL)"
LOW = f"""{CELLS}, sub AS (SELECT *, (qy - mny - tile_row * csy) // greatest(1, csy // {SIDE}) AS sub_row, (qx - mnx - tile_col * csx) // greatest(1, csx // {SIDE}) AS sub_col FROM cells),
low AS (SELECT tile_row, tile_col, sub_row, sub_col, arg_min(point_id, (qz, point_id)) AS point_id, min(qz) AS qz FROM sub WHERE sub_row < {SIDE} AND sub_col < {SIDE} GROUP BY 1, 2, 3, 4)"""
TILES = f"""{LOW}, lc AS (SELECT tile_row, tile_col, count(*) AS lowres_count FROM low GROUP BY ALL),
dens AS (SELECT tile_row, tile_col, count(*) AS n FROM cells GROUP BY ALL),
tiles AS (SELECT tile_row, tile_col, (tile_row << 16) | tile_col AS tile_id, row_number() OVER w - 1 AS valid_index,
 CAST(coalesce(sum(n - coalesce(lowres_count, 0)) OVER b, 0) AS BIGINT) AS point_offset, n AS point_count,
 CAST(coalesce(sum(coalesce(lowres_count, 0)) OVER b, 0) AS BIGINT) AS lowres_offset, coalesce(lowres_count, 0) AS lowres_count
 FROM dens LEFT JOIN lc USING (tile_row, tile_col) WINDOW w AS (ORDER BY tile_row, tile_col), b AS (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
CHUNKS = f"{CELLS}, tc AS (SELECT DISTINCT tile_row, tile_col, point_id // {CHUNK} AS chunk_id FROM cells)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = src.orders(spark, sf_dir)
    return grid.celled(pts, grid.grid(pts, *CELL))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    low = grid.lowres(cells, SIDE).groupBy("tile_row", "tile_col").agg(F.count("*").alias("lowres_count"))
    return grid.tile_table(grid.density(cells), low)


def tile_chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).select("tile_row", "tile_col", grid.chunk_id(CHUNK).alias("chunk_id")).distinct()


EXTENT = "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z"


@query(f"WITH {LINE} SELECT {EXTENT} FROM pts")
def extent_lineitem(spark, d):
    return grid.extent(src.lineitems(spark, d))


@query(f"WITH {PTS}, p2 AS (SELECT x, y, z FROM pts UNION ALL SELECT c_custkey, c_acctbal, c_nationkey FROM customer) SELECT {EXTENT} FROM p2")
def extent_union(spark, d):
    return grid.extent(src.union_sources(src.orders(spark, d), src.customers(spark, d)))


@query(f"WITH {CUST} SELECT point_id, qx, qy, qz FROM pts")
def quantize_customer(spark, d):
    return src.customers(spark, d).select("point_id", "qx", "qy", "qz")


@query(f"WITH {CUST} SELECT point_id, round(qy * 0.01::DOUBLE, 6) AS y2, abs(qy * 0.01::DOUBLE - y) < 0.010001 AS close FROM pts")
def dequantize_roundtrip(spark, d):
    y = quantize.dequantize(F.col("qy"), 0.01, 0.0)
    return src.customers(spark, d).select("point_id", F.round(y, 6).alias("y2"), (F.abs(y - F.col("y")) < 0.010001).alias("close"))


@query(f"""WITH {PTS}, e AS (SELECT min(y) AS lo, max(y) AS hi FROM pts) SELECT round(pow(10, -floor(log10(2147483648.0 / greatest(hi - lo, 1e-9)))), 12) AS scale,
 CASE WHEN lo - floor(lo) > hi - lo THEN lo ELSE floor(lo) END AS offset_ FROM e""")
def auto_quantization(spark, d):
    e = src.orders(spark, d).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return e.select(F.round(quantize.automatic_scale(F.col("lo"), F.col("hi")), 12).alias("scale"), quantize.automatic_offset(F.col("lo"), F.col("hi")).alias("offset_"))


@query(f"WITH {LINE}, {gridded((50, 10))} SELECT tile_row, tile_col, count(*) AS n, min(qz) AS min_qz, max(qz) AS max_qz FROM cells GROUP BY ALL")
def tile_density_lineitem(spark, d):
    pts = src.lineitems(spark, d)
    return grid.density(grid.celled(pts, grid.grid(pts, 50, 10)))


@query(f"""WITH {CELLS} SELECT DISTINCT tile_row, tile_col, mnx + tile_col * csx AS min_qx, least(mnx + (tile_col + 1) * csx, mxx) AS max_qx,
 mny + tile_row * csy AS min_qy, least(mny + (tile_row + 1) * csy, mxy) AS max_qy FROM cells""")
def tile_extents(spark, d):
    low = lambda m, at, cs: F.col(m) + F.col(at) * F.col(cs)
    return order_cells(spark, d).select(
        "tile_row", "tile_col", low("mnx", "tile_col", "csx").alias("min_qx"), F.least(low("mnx", "tile_col", "csx") + F.col("csx"), F.col("mxx")).alias("max_qx"),
        low("mny", "tile_row", "csy").alias("min_qy"), F.least(low("mny", "tile_row", "csy") + F.col("csy"), F.col("mxy")).alias("max_qy"),
    ).distinct()


@query(f"""WITH {DENSITY} SELECT CAST(sum(n) AS BIGINT) AS points, count(*) AS valid_tiles, min(n) AS min_count, max(n) AS max_count,
 list_sort(list(n))[count(*) // 2 + 1] AS median_count, CAST(sum(n) // count(*) AS BIGINT) AS mean_count FROM dens""")
def density_summary(spark, d):
    return grid.density_summary(grid.density(order_cells(spark, d)))


@query(f"WITH {PTS} SELECT round(sqrt((max(x) - min(x)) * (max(y) - min(y)) / least(greatest(1, floor(count(*) / 500)) * 16, 10000000)), 6) AS side FROM pts")
def estimation_grid(spark, d):
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return src.orders(spark, d).agg(F.round(grid.estimation_side(area, F.count("*"), 500), 6).alias("side"))


@query(f"""WITH {DENSITY}, s AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS median_count FROM dens)
 SELECT round(sqrt(500 / (median_count / ({CELL[0]} * 1.0 * {CELL[1]} * 0.01))), 6) AS side FROM s""")
def actual_grid(spark, d):
    summary = grid.density_summary(grid.density(order_cells(spark, d)))
    return summary.select(F.round(grid.side_for_density(F.col("median_count") / (CELL[0] * 1.0 * CELL[1] * 0.01), 500), 6).alias("side"))


HIST = f"""{LINE}, f AS (SELECT min(qz) AS mn, max(qz) AS mx FROM pts), f2 AS (SELECT mn, mx, greatest(CASE WHEN mx > mn + 1 THEN length(bin(mx - mn - 1)) ELSE 0 END - 10, 0) AS s FROM f),
hist AS (SELECT least((qz >> s) - (mn >> s), (mx - mn) >> s) AS bin, count(*) AS n FROM pts, f2 GROUP BY ALL)"""


@query(f"WITH {HIST} SELECT bin, n FROM hist")
def z_histogram(spark, d):
    return grid.z_histogram(src.lineitems(spark, d))


@query(f"""WITH {HIST}, c AS (SELECT bin, n, (bin + 0.5::DOUBLE) / (((mx - mn) >> s) + 1) * (mx - mn) + mn AS c FROM hist, f2),
 m AS (SELECT sum(n) AS t, sum(n * c) / sum(n) AS mean, arg_max(c, (n, -bin)) AS mode FROM c)
 SELECT round(max(mean), 3) AS mean, round(sum(n * (c - mean) * (c - mean)) / (max(t) - 1), 1) AS variance, round(max(m.mode), 3) AS mode FROM c, m""")
def z_statistics(spark, d):
    pts = src.lineitems(spark, d)
    return grid.histogram_statistics(grid.z_histogram(pts), pts)


@query(f"WITH {PTS}, f AS (SELECT min(y) AS lo, max(y) AS hi FROM pts) SELECT least(CAST(floor((y - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM pts, f GROUP BY ALL")
def simple_histogram(spark, d):
    pts = src.orders(spark, d)
    f = pts.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    bin_ = F.least(F.floor((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("bigint")
    return pts.crossJoin(F.broadcast(f)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {LOW} SELECT * FROM low")
def lowres_points(spark, d):
    return grid.lowres(order_cells(spark, d), SIDE)


@query(f"WITH {LOW} SELECT tile_row, tile_col, count(*) AS lowres_count FROM low GROUP BY ALL")
def lowres_counts(spark, d):
    return grid.lowres(order_cells(spark, d), SIDE).groupBy("tile_row", "tile_col").agg(F.count("*").alias("lowres_count"))


@query(f"WITH {TILES} SELECT * FROM tiles")
def tile_table(spark, d):
    return tiles(spark, d)


@query(f"WITH {CELLS} SELECT point_id, qx, qy, qz FROM cells WHERE tile_row * n_cols + tile_col BETWEEN 12 AND 40")
def tile_range_filter(spark, d):
    return order_cells(spark, d).where((F.col("tile_row") * F.col("n_cols") + F.col("tile_col")).between(12, 40)).select("point_id", "qx", "qy", "qz")


@query("SELECT o_orderkey AS point_id FROM orders WHERE o_custkey BETWEEN 100 AND 200 AND o_totalprice BETWEEN 100000 AND 200000")
def extent_filter(spark, d):
    return src.orders(spark, d).where(F.col("x").between(100, 200) & F.col("y").between(100000, 200000)).select("point_id")


@query(f"WITH {DENSITY}, t AS (SELECT least(CAST(floor(0.37 * n_rows) AS BIGINT), n_rows - 1) AS tile_row, least(CAST(floor(0.62 * n_cols) AS BIGINT), n_cols - 1) AS tile_col FROM g) SELECT tile_row, tile_col, n FROM dens JOIN t USING (tile_row, tile_col)")
def tile_by_ratio(spark, d):
    pts = src.orders(spark, d)
    definition = grid.grid(pts, *CELL)
    at = lambda ratio, n: F.least(F.floor(F.lit(ratio) * F.col(n)), F.col(n) - 1).cast("bigint")
    wanted = definition.select(at(0.37, "n_rows").alias("tile_row"), at(0.62, "n_cols").alias("tile_col"))
    return grid.density(grid.celled(pts, definition)).join(F.broadcast(wanted), ["tile_row", "tile_col"]).select("tile_row", "tile_col", "n")


AROUND = f"{DENSITY}, near AS (SELECT tile_row, tile_col, n, (tile_row - 5) * (tile_row - 5) + (tile_col - 5) * (tile_col - 5) AS d2 FROM dens WHERE abs(tile_row - 5) <= 4 AND abs(tile_col - 5) <= 4)"


def around(spark, d):
    dr, dc = F.col("tile_row") - 5, F.col("tile_col") - 5
    return grid.density(order_cells(spark, d)).where((F.abs(dr) <= 4) & (F.abs(dc) <= 4)).select("tile_row", "tile_col", "n", (dr * dr + dc * dc).alias("d2"))


@query(f"WITH {AROUND} SELECT * FROM near")
def tile_neighbourhood(spark, d):
    return around(spark, d)


@query(f"WITH {AROUND}, r AS (SELECT *, sum(n) OVER (ORDER BY d2, tile_row, tile_col) AS total FROM near) SELECT tile_row, tile_col, n FROM r WHERE total <= 2000")
def tile_eviction(spark, d):
    return grid.within_budget(around(spark, d), ["d2", "tile_row", "tile_col"], 2000).select("tile_row", "tile_col", "n")


@query(f"WITH {CELLS} SELECT point_id, qx, qy, qz FROM cells WHERE tile_row = 3 AND tile_col = 4")
def tile_read(spark, d):
    """One tile of a store, by the folders and row groups that hold it."""
    path = scratch(spark, "tiled")
    tiled.write_tiled(src.orders(spark, d), CELL, path, SIDE)
    return tiled.open_tiled(spark, path).read((3, 3), (4, 4)).select("point_id", "qx", "qy", "qz")


@query(f"WITH {CHUNKS} SELECT * FROM tc")
def tile_chunks(spark, d):
    return tile_chunks_of(spark, d)


@query(f"WITH {CHUNKS} SELECT DISTINCT chunk_id FROM tc WHERE tile_row BETWEEN 2 AND 3")
def segment_chunks(spark, d):
    return tile_chunks_of(spark, d).where("tile_row between 2 and 3").select("chunk_id").distinct()


@query(f"WITH {CELLS}, tc AS (SELECT DISTINCT tile_row, tile_col, point_id // 20 AS chunk_id FROM cells) SELECT chunk_id FROM tc WHERE tile_row = 3 EXCEPT SELECT chunk_id FROM tc WHERE tile_row = 2")
def unseen_chunks(spark, d):
    tc = order_cells(spark, d).select("tile_row", grid.chunk_id(20).alias("chunk_id")).distinct()
    return tc.where("tile_row = 3").select("chunk_id").join(tc.where("tile_row = 2").select("chunk_id"), "chunk_id", "left_anti")


@query(f"WITH {CHUNKS}, c AS (SELECT DISTINCT chunk_id FROM tc WHERE tile_row = 3 AND tile_col = 4), i AS (SELECT chunk_id, chunk_id - row_number() OVER (ORDER BY chunk_id) AS island FROM c) SELECT min(chunk_id) AS start, count(*) AS length FROM i GROUP BY island")
def chunk_runs(spark, d):
    return grid.runs(tile_chunks_of(spark, d).where("tile_row = 3 and tile_col = 4").select("chunk_id").distinct(), "chunk_id")


@query(f"WITH {CHUNKS} SELECT point_id, qx, qy, qz FROM pts WHERE point_id // {CHUNK} IN (SELECT chunk_id FROM tc WHERE tile_row = 3 AND tile_col = 4)")
def sparse_scan(spark, d):
    wanted = tile_chunks_of(spark, d).where("tile_row = 3 and tile_col = 4").select("chunk_id").distinct()
    return src.orders(spark, d).withColumn("chunk_id", grid.chunk_id(CHUNK)).join(wanted, "chunk_id", "left_semi").select("point_id", "qx", "qy", "qz")


@query(f"""WITH {DENSITY} SELECT c.tile_row // 2 AS big_row, c.tile_col // 2 AS big_col, c.tile_row, c.tile_col, c.n FROM dens c""")
def cell_overlap(spark, d):
    fine = grid.density(order_cells(spark, d)).select("tile_row", "tile_col", "n")
    big = fine.select(grid.quotient(F.col("tile_row"), 2).alias("big_row"), grid.quotient(F.col("tile_col"), 2).alias("big_col")).distinct()
    covered = big.withColumn("tile_row", F.explode(F.sequence(F.col("big_row") * 2, F.col("big_row") * 2 + 1))).withColumn("tile_col", F.explode(F.sequence(F.col("big_col") * 2, F.col("big_col") * 2 + 1)))
    return covered.join(fine, ["tile_row", "tile_col"]).select("big_row", "big_col", "tile_row", "tile_col", "n")


@query("SELECT o_orderkey AS point_id FROM orders WHERE ceil(o_orderkey / 3.7::DOUBLE) * 3.7::DOUBLE < o_orderkey + 1")
def thin_points(spark, d):
    return grid.thinned(src.orders(spark, d), "point_id", 3.7).select("point_id")


@query(f"WITH {PTS} SELECT point_id, qx, qy, qz FROM pts WHERE point_id >= 1000 AND point_id < 2500")
def point_segment(spark, d):
    return src.orders(spark, d).where("point_id >= 1000 and point_id < 2500").select("point_id", "qx", "qy", "qz")


@query(f"WITH {PTS} SELECT point_id, qx, qy, qz FROM pts UNION ALL SELECT c_custkey, c_custkey, CAST(trunc(c_acctbal / 0.01) AS BIGINT), c_nationkey FROM customer")
def union_sources(spark, d):
    return src.union_sources(src.orders(spark, d), src.customers(spark, d)).select("point_id", "qx", "qy", "qz")


MORTON = " + ".join(f"((tile_col >> {b}) & 1) * {1 << 2 * b} + ((tile_row >> {b}) & 1) * {2 << 2 * b}" for b in range(10))


@query(f"WITH {DENSITY} SELECT tile_row, tile_col, CAST({MORTON} AS BIGINT) AS z_order FROM dens")
def morton_order(spark, d):
    return grid.density(order_cells(spark, d)).select("tile_row", "tile_col", grid.morton(F.col("tile_row"), F.col("tile_col"), 10).alias("z_order"))


PIX = f"{PTS}, f AS (SELECT min(qx) AS ax, max(qx) AS bx, min(qy) AS ay, max(qy) AS by_, min(qz) AS az FROM pts), pix AS (SELECT least((qy - ay) * 200 // greatest(by_ - ay, 1), 199) AS py, least((qx - ax) * 200 // greatest(bx - ax, 1), 199) AS px, max(qz) AS qz, max(az) AS az FROM pts, f GROUP BY 1, 2)"


def pixels(spark, d):
    pts = src.orders(spark, d)
    f = pts.agg(F.min("qx").alias("ax"), F.max("qx").alias("bx"), F.min("qy").alias("ay"), F.max("qy").alias("by_"), F.min("qz").alias("az"))
    at = lambda q, a, b: F.least(F.expr(f"({q} - {a}) * 200 div greatest({b} - {a}, 1)"), F.lit(199))
    return pts.crossJoin(F.broadcast(f)).groupBy(at("qy", "ay", "by_").alias("py"), at("qx", "ax", "bx").alias("px")).agg(F.max("qz").alias("qz"), F.max("az").alias("az"))


@query(f"WITH {PIX} SELECT py, px, qz FROM pix")
def preview_raster(spark, d):
    return pixels(spark, d).drop("az")


@query(f"WITH {CELLS} SELECT tile_row, tile_col, (qy - mny - tile_row * csy) * 8 // csy AS py, (qx - mnx - tile_col * csx) * 8 // csx AS px, max(qz) AS qz FROM cells GROUP BY ALL")
def tile_raster(spark, d):
    py, px = F.expr("(qy - mny - tile_row * csy) * 8 div csy").alias("py"), F.expr("(qx - mnx - tile_col * csx) * 8 div csx").alias("px")
    return order_cells(spark, d).groupBy("tile_row", "tile_col", py, px).agg(F.max("qz").alias("qz"))


@query(f"WITH {PIX} SELECT py, px, (qz - az) * 1.0::DOUBLE AS height FROM pix")
def unquantized_raster(spark, d):
    return pixels(spark, d).select("py", "px", ((F.col("qz") - F.col("az")) * F.lit(1.0)).alias("height"))


@query(f"WITH {PIX} SELECT py, px, (qz - az) * 3.5::DOUBLE + az AS height FROM pix")
def exaggerate(spark, d):
    return pixels(spark, d).select("py", "px", ((F.col("qz") - F.col("az")) * F.lit(3.5) + F.col("az")).alias("height"))


@query(f"WITH {LINE} SELECT round(greatest(min(z), avg(z) - 2 * stddev_samp(z)), 3) AS low, round(least(max(z), avg(z) + 2 * stddev_samp(z)), 3) AS high FROM pts")
def stretch_stddev(spark, d):
    low, high = records.stddev_stretch(F.avg("z"), F.stddev_samp("z"), F.min("z"), F.max("z"), 2.0)
    return src.lineitems(spark, d).agg(F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


BINNED = "CASE WHEN z <= 20000 THEN 0 ELSE least(CAST(floor((z - 20000) / 60000.0::DOUBLE * 64) AS INTEGER), 63) END"


@query(f"WITH {LINE} SELECT {BINNED} AS bin, count(*) AS n FROM pts GROUP BY ALL")
def interval_map(spark, d):
    bin_ = records.interval(F.col("z"), F.lit(20000.0), F.lit(80000.0), 64)
    return src.lineitems(spark, d).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


STOPS = [(0, 0, 128), (0, 160, 64), (255, 255, 0), (255, 0, 0)]


def ramp_sql(c: int, stops: list = STOPS) -> str:
    values = ", ".join(str(s[c]) for s in stops)
    return f"CAST(trunc([{values}][k + 1] + (p - k) * ([{values}][k + 2] - [{values}][k + 1])) AS INTEGER)"


@query(f"WITH {CUST}, r AS (SELECT point_id, least(greatest((y + 1000) / 11000.0::DOUBLE, 0), 1) * 3 AS p FROM pts), k AS (SELECT point_id, p, least(CAST(floor(p) AS INTEGER), 2) AS k FROM r) SELECT point_id, {ramp_sql(0)} * 65536 + {ramp_sql(1)} * 256 + {ramp_sql(2)} AS rgb FROM k")
def color_ramp(spark, d):
    return src.customers(spark, d).select("point_id", records.ramp((F.col("y") + 1000) / 11000.0, STOPS).alias("rgb"))


@query("SELECT p_partkey, CAST(trunc((p_partkey % 65536) * (255.0::DOUBLE / 65536)) AS INTEGER) | (CAST(trunc((p_partkey * 7 % 65536) * (255.0::DOUBLE / 65536)) AS INTEGER) << 8) | (CAST(trunc((p_partkey * 31 % 65536) * (255.0::DOUBLE / 65536)) AS INTEGER) << 16) AS rgb FROM part")
def rgb_pack(spark, d):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", records.rgb_pack(k % 65536, k * 7 % 65536, k * 31 % 65536).alias("rgb"))


@query("SELECT p_partkey, CAST(p_partkey & 7 AS INTEGER) AS return_number, CAST((p_partkey >> 3) & 7 AS INTEGER) AS return_count, CAST((p_partkey >> 6) & 1 AS INTEGER) AS scan_direction, CAST((p_partkey >> 7) & 1 AS INTEGER) AS flight_edge FROM part")
def return_bits(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *records.return_bits(F.col("p_partkey").cast("int")))


LEAF = f"""{CUST}, root AS (SELECT min(x) AS rx, min(y) AS ry, greatest(max(x) - min(x), max(y) - min(y)) AS dim FROM pts),
leaf AS (SELECT CAST(least(floor((x - rx) / dim * {1 << LEVELS}), {(1 << LEVELS) - 1}) AS BIGINT) AS cx, CAST(least(floor((y - ry) / dim * {1 << LEVELS}), {(1 << LEVELS) - 1}) AS BIGINT) AS cy FROM pts, root),
nodes AS (""" + " UNION ALL ".join(
    f"SELECT {d} AS depth, {' || '.join(f'CAST(((cy >> {LEVELS - 1 - i}) & 1) * 2 + ((cx >> {LEVELS - 1 - i}) & 1) AS VARCHAR)' for i in range(d)) or repr('')} AS path, count(*) AS n FROM leaf GROUP BY 1, 2" for d in range(LEVELS + 1)
) + ")"
LEAVES = f"{LEAF}, leaves AS (SELECT a.depth, a.path, a.n FROM nodes a JOIN nodes b ON b.depth = a.depth - 1 AND b.path = a.path[1:a.depth - 1] AND b.n >= 40 WHERE a.depth > 0 AND (a.n < 40 OR a.depth = {LEVELS}))"


@query(f"WITH {LEAF} SELECT * FROM nodes")
def quadtree_nodes(spark, d):
    return surface.quadtree(src.customers(spark, d), LEVELS)


@query(f"WITH {LEAVES} SELECT * FROM leaves")
def quadtree_leaves(spark, d):
    return surface.quadtree_leaves(surface.quadtree(src.customers(spark, d), LEVELS), LEVELS, 40)


@query(f"WITH {LEAVES} SELECT count(*) AS leaves, round(min(n * pow(4, depth)), 3) AS least, round(max(n * pow(4, depth)), 3) AS most, max(depth) AS deepest FROM leaves")
def quadtree_density(spark, d):
    per_area = F.col("n") * F.pow(F.lit(4.0), "depth")
    found = surface.quadtree_leaves(surface.quadtree(src.customers(spark, d), LEVELS), LEVELS, 40)
    return found.agg(F.count("*").alias("leaves"), F.round(F.min(per_area), 3).alias("least"), F.round(F.max(per_area), 3).alias("most"), F.max("depth").alias("deepest"))


@query(f"WITH {PTS}, f AS (SELECT min(qx) AS ax, max(qx) AS bx, min(qy) AS ay, max(qy) AS by_ FROM pts), c AS (SELECT least((qy - ay) * 64 // greatest(by_ - ay, 1), 63) AS r, least((qx - ax) * 64 // greatest(bx - ax, 1), 63) AS c, count(*) AS n FROM pts, f GROUP BY 1, 2) SELECT r, c, least(4 * n // (SELECT max(n) FROM c), 3) AS shade FROM c")
def density_map_64(spark, d):
    pts = src.orders(spark, d)
    f = pts.agg(F.min("qx").alias("ax"), F.max("qx").alias("bx"), F.min("qy").alias("ay"), F.max("qy").alias("by_"))
    at = lambda q, a, b: F.least(F.expr(f"({q} - {a}) * 64 div greatest({b} - {a}, 1)"), F.lit(63))
    cells = pts.crossJoin(F.broadcast(f)).groupBy(at("qy", "ay", "by_").alias("r"), at("qx", "ax", "bx").alias("c")).agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.max("n").alias("most")))).select("r", "c", F.least(F.expr("4 * n div most"), F.lit(3)).alias("shade"))


CORNERS = [(100.5, 50000.5), (900.5, 90000.5), (700.5, 400000.5), (300.5, 300000.5)]
CROSSINGS = " + ".join(
    f"CASE WHEN ({y0} > y) <> ({y1} > y) AND x < {x1 - x0}::DOUBLE * (y - {y0}::DOUBLE) / {y1 - y0}::DOUBLE + {x0}::DOUBLE THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)
)


@query(f"WITH {PTS} SELECT point_id FROM pts WHERE ({CROSSINGS}) % 2 = 1")
def polygon_filter(spark, d):
    box = F.col("x").between(100.5, 900.5) & F.col("y").between(50000.5, 400000.5)
    return src.orders(spark, d).where(box & surface.inside_polygon(F.col("x"), F.col("y"), CORNERS)).select("point_id")


T = "least(greatest(((x - 100) * 800.0::DOUBLE + (y - 1000) * 4000.0::DOUBLE) / 16640000.0::DOUBLE, 0), 1)"


@query(f"WITH {CUST}, t AS (SELECT point_id, x, y, z, {T} AS t FROM pts) SELECT point_id, round(t, 9) AS along, z FROM t WHERE (x - (100 + t * 800)) * (x - (100 + t * 800)) + (y - (1000 + t * 4000)) * (y - (1000 + t * 4000)) <= 90000")
def profile_line(spark, d):
    t, d2 = surface.along_segment(F.col("x"), F.col("y"), (100.0, 1000.0), (900.0, 5000.0))
    return src.customers(spark, d).where(d2 <= 90000).select("point_id", F.round(t, 9).alias("along"), "z")


@query(f"WITH {CUST} SELECT point_id, round((0.6::DOUBLE * (x - 10) + 0.8::DOUBLE * (z - 2)), 9) AS distance FROM pts")
def plane_distance(spark, d):
    return src.customers(spark, d).select("point_id", F.round(0.6 * (F.col("x") - 10) + 0.8 * (F.col("z") - 2), 9).alias("distance"))


RC = f"{CELLS}, rc AS (SELECT tile_row AS r, tile_col AS c, max(qz) AS v FROM cells GROUP BY ALL)"
JOINED = f"{RC}, j AS (SELECT a.r, a.c, a.v, l.v AS l, u.v AS u, k.v AS k FROM rc a LEFT JOIN rc l ON l.r = a.r AND l.c = a.c - 1 LEFT JOIN rc u ON u.r = a.r - 1 AND u.c = a.c LEFT JOIN rc k ON k.r = a.r - 1 AND k.c = a.c - 1)"
S = 1 << 20


def surface_cells(spark, d):
    return surface.raster(order_cells(spark, d)).select(F.col("tile_row").alias("r"), F.col("tile_col").alias("c"), F.col("qz").alias("v"))


TRI = f"""{JOINED}, tri AS (SELECT r * {S} + c AS a, r * {S} + c - 1 AS b, (r - 1) * {S} + c AS c3 FROM j WHERE l IS NOT NULL AND u IS NOT NULL
 UNION ALL SELECT (r - 1) * {S} + c - 1, (r - 1) * {S} + c, r * {S} + c - 1 FROM j WHERE l IS NOT NULL AND u IS NOT NULL AND k IS NOT NULL)"""


@query(f"WITH {TRI} SELECT a, b, c3 AS c FROM tri")
def mesh_triangles(spark, d):
    return surface.triangles(surface_cells(spark, d))


@query(f"WITH {TRI}, v AS (SELECT unnest([a, b, c3]) AS vertex FROM tri) SELECT vertex, count(*) AS faces FROM v GROUP BY ALL")
def vertex_faces(spark, d):
    t = surface.triangles(surface_cells(spark, d))
    return t.select(F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("faces"))


@query(f"WITH {JOINED} SELECT r, c, round(greatest(1.0::DOUBLE / sqrt(1.0::DOUBLE + pow(u - k, 2) + pow(v - u, 2)), 1.0::DOUBLE / sqrt(1.0::DOUBLE + pow(v - l, 2) + pow(l - k, 2))), 9) AS nz FROM j WHERE l IS NOT NULL AND u IS NOT NULL AND k IS NOT NULL")
def slope(spark, d):
    return surface.slopes(surface_cells(spark, d))


@query(f"WITH {DENSITY} SELECT a.tile_row AS r, a.tile_col AS c, CAST(sum(b.n) AS BIGINT) AS around FROM dens a JOIN dens b ON abs(a.tile_row - b.tile_row) <= 2 AND abs(a.tile_col - b.tile_col) <= 2 GROUP BY ALL")
def neighbour_count(spark, d):
    cells = grid.density(order_cells(spark, d)).select(F.col("tile_row").alias("r"), F.col("tile_col").alias("c"), F.col("n").alias("v"))
    return surface.neighbour_sums(cells, 2)


SEG = f"""WITH RECURSIVE {CELLS}, rc AS (SELECT tile_row AS r, tile_col AS c, max(qz) AS v FROM cells GROUP BY ALL), e AS (SELECT a.r * 4096 + a.c AS a, b.r * 4096 + b.c AS b FROM rc a JOIN rc b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND abs(a.v - b.v) <= 10),
reach AS (SELECT r * 4096 + c AS id, r * 4096 + c AS label FROM rc UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.id WHERE reach.label < e.b), seg AS (SELECT id, min(label) AS label FROM reach GROUP BY id)"""


@query(f"{SEG} SELECT id // 4096 AS r, id % 4096 AS c, label FROM seg")
def segmentation(spark, d):
    return segments.segments(surface_cells(spark, d), 10, 4096, tile=16).drop("size")


@query(f"{SEG} SELECT label, count(*) AS cells FROM seg GROUP BY label")
def segment_sizes(spark, d):
    return segments.segments(surface_cells(spark, d), 10, 4096, tile=16).groupBy("label").agg(F.count("*").alias("cells"))


@query("SELECT o_custkey AS k, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def distinct_by_key(spark, d):
    return src.orders(spark, d).groupBy(F.col("qx").alias("k")).agg(F.min("point_id").alias("first_id"))


@query("SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS kinds, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS compatible FROM lineitem")
def header_compat(spark, d):
    kinds = F.count_distinct(F.struct("l_returnflag", "l_linestatus"))
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(kinds.alias("kinds"), (kinds == 1).alias("compatible"))


@query(f"WITH {LINE} SELECT count(*) AS n, max(z) AS max_z FROM pts")
def full_scan(spark, d):
    return src.lineitems(spark, d).agg(F.count("*").alias("n"), F.max("z").alias("max_z"))


@query(f"WITH {CHUNKS}, k AS (SELECT point_id // {CHUNK} AS chunk_id, count(*) AS n FROM pts GROUP BY 1) SELECT max(n) AS most FROM k")
def chunk_maximum(spark, d):
    return src.orders(spark, d).groupBy(grid.chunk_id(CHUNK).alias("chunk_id")).count().agg(F.max("count").alias("most"))


def preset_sql(name: str, reverse: bool) -> str:
    stops = records.ramp_stops(name, reverse)
    parts = len(stops) - 1
    return f"""SELECT point_id, '{name}' AS ramp, {ramp_sql(0, stops)} * 65536 + {ramp_sql(1, stops)} * 256 + {ramp_sql(2, stops)} AS rgb FROM
  (SELECT point_id, p, least(CAST(floor(p) AS INTEGER), {parts - 1}) AS k FROM (SELECT point_id, least(greatest((y + 1000) / 11000.0::DOUBLE, 0), 1) * {parts} AS p FROM pts))"""


PRESETS = [(name, name == "Elevation2") for name in records.RAMPS]


@query(f"WITH {CUST} " + " UNION ALL ".join(preset_sql(*p) for p in PRESETS))
def ramp_presets(spark, d):
    """All published ramps, one of them reversed."""
    ramps = F.array(*[F.struct(F.lit(n).alias("ramp"), records.ramp((F.col("y") + 1000) / 11000.0, records.ramp_stops(n, r)).alias("rgb")) for n, r in PRESETS])
    return src.customers(spark, d).select("point_id", F.explode(ramps).alias("v")).select("point_id", "v.*")


@query(f"WITH {PTS} SELECT point_id, qx, qy, qz, x, round(qy * 0.01::DOUBLE, 2) AS y, z FROM pts")
def las_roundtrip(spark, d):
    """Points written as LAS files and read again; the id travels as the time of the point."""
    folder = scratch(spark, "las")
    pts = src.orders(spark, d).withColumn("gps_time", F.col("point_id").cast("double"))
    las.write_las(pts, folder, src.Quantization((1.0, 0.01, 1.0))).write.format("noop").mode("overwrite").save()
    back = las.read_las(spark, folder)
    return back.select(F.col("gps_time").cast("bigint").alias("point_id"), *[F.col(c).cast("bigint").alias(c) for c in ("qx", "qy", "qz")], "x", F.round("y", 2).alias("y"), "z")


@query(f"WITH {PTS} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM pts")
def las_headers(spark, d):
    """The merged headers of written LAS files: counts are summed, extents united."""
    folder = scratch(spark, "las-headers")
    pts = src.orders(spark, d).withColumn("gps_time", F.lit(None).cast("double"))
    las.write_las(pts, folder, src.Quantization((1.0, 0.01, 1.0))).write.format("noop").mode("overwrite").save()
    low, high = (lambda i: F.min(F.get("min_xyz", F.lit(i)))), (lambda i: F.max(F.get("max_xyz", F.lit(i))))
    return las.headers(spark, folder).agg(F.sum("n_points").alias("n"), low(0).alias("min_x"), high(0).alias("max_x"), low(2).alias("min_z"), high(2).alias("max_z"))


@query(f"WITH {CUST} SELECT x, round(y, 2) AS y, z FROM pts")
def xyz_parse(spark, d):
    path = scratch(spark, "xyz")
    xyz.write_xyz(src.customers(spark, d), path)
    return xyz.read_xyz(spark, path)


@query(f"WITH {DENSITY} SELECT tile_row, tile_col, n, min_qz, max_qz FROM dens")
def streamed_density(spark, d):
    """The density of tiles over a stream of files of points, some files a batch."""
    folder = scratch(spark, "stream")
    src.orders(spark, d).write.parquet(f"{folder}/points")
    pts = spark.read.parquet(f"{folder}/points")
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/points")
    return stream_density(stream, grid.grid(pts, *CELL), f"{folder}/state")
