"""Registered queries of vectors, triangles, records, text files, scales and file sets, with their SQL."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geometry, quantize, records, scales
from tessera.operators import delaunay, grid
from tessera.operators.ordered import numbered, running_sums
from tessera.options import PRECISION_BYTES
from tessera.plans.catalogue import CELL, CELLS, CUST, LINE, PTS, STOPS, order_cells, query, ramp_sql
from tessera.plans.shapes import las_orders
from tessera.sources import las, lasformat, laz, xyz
from tessera.sources import points as src
from tessera.sources.scratch import scratch

def place() -> geometry.Vector:
    return tuple(F.col(a) for a in "xyz")


@query(f"WITH {CUST} SELECT point_id, round((x + 1) * 2 - 1, 6) AS a, round((y - 2) / 4, 6) AS b, round(z * z, 6) AS c, x / nullif(z, 0) AS d FROM pts")
def point_arithmetic(spark, d):
    """Sums, differences, products and quotients of points and scalars."""
    one, two = tuple(F.lit(v) for v in (1.0, 2.0, 3.0)), tuple(F.lit(v) for v in (1.0, 1.0, 1.0))
    a = geometry.minus(geometry.times(geometry.plus(place(), one), 2.0), two)[0]
    b = geometry.over(geometry.minus(place(), one), 4.0)[1]
    ratio = geometry.over(place(), (place()[2], place()[2], place()[2]))[0]
    return src.customers(spark, d).select("point_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(geometry.times(place(), place())[2], 6).alias("c"), ratio.alias("d"))


@query(f"WITH {PTS} SELECT point_id, row_number() OVER (ORDER BY qx, qy, qz, point_id) - 1 AS position FROM pts")
def ordered_points(spark, d):
    """The numbers of points in their order by x, then y, then z."""
    return numbered(src.orders(spark, d).select("point_id", "qx", "qy", "qz"), ["qx", "qy", "qz", "point_id"], ["point_id"]).drop("total")


MODE = """f AS (SELECT min(qz) AS mn, max(qz) AS mx FROM pts), f2 AS (SELECT mn, mx, greatest(CASE WHEN mx > mn + 1 THEN length(bin(mx - mn - 1)) ELSE 0 END - 10, 0) AS s FROM f),
 k AS (SELECT least((qz >> s) - (mn >> s), (mx - mn) >> s) AS b, count(*) AS n, max(mn) AS mn, max(mx) AS mx, max(s) AS s FROM pts, f2 GROUP BY 1),
 c AS (SELECT b, n, (b + 0.5::DOUBLE) / (((mx - mn) >> s) + 1) * (mx - mn) + mn AS c FROM k), st AS (SELECT sum(n * c) / sum(n) AS mean, sum(n) AS n FROM c), va AS (SELECT sum(c.n * (c - mean) * (c - mean)) / (max(st.n) - 1) AS v, max(mean) AS mean, arg_max(c, (c.n, -b)) AS mode FROM c, st)"""


@query(f"WITH {PTS}, {MODE} SELECT (SELECT (min(x) + max(x)) / 2 FROM pts) AS x, (SELECT (min(y) + max(y)) / 2 FROM pts) AS y, round(mode, 3) AS z FROM va")
def centre_of_mass(spark, d):
    """The middle of the plane's extent at the most frequent height."""
    pts = src.orders(spark, d)
    heights = grid.histogram_statistics(grid.z_histogram(pts), pts)
    return pts.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y")).crossJoin(heights.select(F.col("mode").alias("z")))


@query(f"WITH {PTS}, {MODE} SELECT CAST(trunc((round(mean, 3) - 5) / 0.25::DOUBLE) AS BIGINT) AS mean, CAST(trunc(sqrt(round(v, 1)) / 0.25::DOUBLE) AS BIGINT) AS deviation, CAST(trunc((round(mode, 3) - 5) / 0.25::DOUBLE) AS BIGINT) AS mode FROM va")
def quantized_statistics(spark, d):
    """Mean, standard deviation and mode in a quantization."""
    pts = src.orders(spark, d)
    s = grid.histogram_statistics(grid.z_histogram(pts), pts)
    return s.select(quantize.quantize(F.col("mean"), 0.25, 5.0).alias("mean"), quantize.quantize(F.sqrt("variance"), 0.25, 0.0).alias("deviation"), quantize.quantize(F.col("mode"), 0.25, 5.0).alias("mode"))


CORNERS = [(100.0, 0.0), (700.0, 9000.0), (1300.0, 500.0)]


def lits(corners):
    return [(F.lit(x), F.lit(y)) for x, y in corners]


@query(f"WITH {CUST} SELECT point_id, CASE WHEN abs(k) >= 1e-12 THEN k ELSE 0 END AS turn, least(pow(x - 100, 2) + pow(y, 2), pow(x - 700, 2) + pow(y - 9000, 2), pow(x - 1300, 2) + pow(y - 500, 2)) <= 1e-5 AS corner FROM (SELECT *, (100 - x) * (9000 - y) - (700 - x) * (0 - y) AS k FROM pts)")
def turns_and_corners(spark, d):
    """Which way three points turn, and whether one is a corner of a triangle."""
    (ax, ay), (bx, by), _ = lits(CORNERS)
    return src.customers(spark, d).select("point_id", geometry.snapped_turn(F.col("x"), F.col("y"), ax, ay, bx, by).alias("turn"), geometry.coincident(F.col("x"), F.col("y"), lits(CORNERS)).alias("corner"))


TRIANGLES = f"""{CUST}, t AS (SELECT point_id, x AS ax, y AS ay, x + z * 10 + 1 AS bx, y + 300 AS by_, x + 400 AS cx, y - z * 20 AS cy FROM pts), k AS (SELECT *, bx - ax AS p, by_ - ay AS q, cx - ax AS r, cy - ay AS s FROM t),
 o AS (SELECT *, 2 * (p * s - q * r) AS d, p * p + q * q AS e, r * r + s * s AS f FROM k), u AS (SELECT *, (s * e - q * f) / nullif(d, 0) AS ux, (p * f - r * e) / nullif(d, 0) AS uy FROM o)"""
BOX = (300.0, 1000.0, 900.0, 6000.0)


def customer_triangles(spark, d):
    x, y, z = place()
    return src.customers(spark, d).select("point_id", x.alias("ax"), y.alias("ay"), (x + z * 10 + 1).alias("bx"), (y + 300).alias("by"), (x + 400).alias("cx"), (y - z * 20).alias("cy"))


def triangle() -> list:
    return [(F.col(f"{p}x"), F.col(f"{p}y")) for p in "abc"]


@query(f"WITH {TRIANGLES} SELECT point_id, round(coalesce(ax + ux, (ax + bx + cx) / 3) - coalesce(sqrt(ux * ux + uy * uy), 0) - 0.005, 4) AS low_x, round(coalesce(ay + uy, (ay + by_ + cy) / 3) - coalesce(sqrt(ux * ux + uy * uy), 0) - 0.005, 4) AS low_y, round(coalesce(ax + ux, (ax + bx + cx) / 3) + coalesce(sqrt(ux * ux + uy * uy), 0) + 0.005, 4) AS high_x, round(coalesce(ay + uy, (ay + by_ + cy) / 3) + coalesce(sqrt(ux * ux + uy * uy), 0) + 0.005, 4) AS high_y FROM u")
def circle_extents(spark, d):
    """The extents of circles through three points each."""
    box = geometry.circle_extent(triangle())
    return customer_triangles(spark, d).select("point_id", *[F.round(v, 4).alias(n) for v, n in zip(box, ("low_x", "low_y", "high_x", "high_y"), strict=True)])


def outer_sql(p: str, q: str) -> str:
    turns = ", ".join(f"sign(d) * (({qx} - {px}) * ({y} - {py}) - ({qy} - {py}) * ({x} - {px}))" for x in (BOX[0], BOX[2]) for y in (BOX[1], BOX[3]) for (px, py), (qx, qy) in [(p.split(","), q.split(","))])
    return f"greatest({turns}) >= 0"


WITHIN = f"least(ax, bx, cx) >= {BOX[0]} AND least(ay, by_, cy) >= {BOX[1]} AND greatest(ax, bx, cx) <= {BOX[2]} AND greatest(ay, by_, cy) <= {BOX[3]}"


@query(f"WITH {TRIANGLES} SELECT point_id, {WITHIN} AS inside, ({WITHIN}) OR ({outer_sql('ax,ay', 'bx,by_')} AND {outer_sql('bx,by_', 'cx,cy')} AND {outer_sql('cx,cy', 'ax,ay')}) AS overlaps FROM o")
def triangles_in_extent(spark, d):
    """Which triangles lie in an extent, and which may overlap it."""
    return customer_triangles(spark, d).select("point_id", geometry.triangle_within(triangle(), BOX).alias("inside"), geometry.triangle_overlaps(triangle(), BOX).alias("overlaps"))


@query(f"WITH {CUST} SELECT point_id, abs((x * 0.6::DOUBLE + z * 0.8::DOUBLE)) <= 300 AS near FROM pts")
def near_plane(spark, d):
    """Points at most 300 from a plane through three points."""
    corners = [tuple(F.lit(v) for v in p) for p in ((0.0, 0.0, 0.0), (8.0, 0.0, -6.0), (0.0, 5.0, 0.0))]
    return src.customers(spark, d).select("point_id", geometry.near_plane(place(), corners, 300.0).alias("near"))


@query(f"WITH {CUST}, e AS (SELECT min(x) AS rx, min(y) AS ry, greatest(max(x) - min(x), max(y) - min(y)) AS dim FROM pts) SELECT point_id, x >= rx AND y >= ry + dim / 2 AND x < rx + dim / 2 AND y < ry + dim AS inside FROM pts, e")
def node_contains(spark, d):
    """Which points lie in one quadrant of a tree's root."""
    pts = src.customers(spark, d)
    root = pts.agg(F.min("x").alias("rx"), F.min("y").alias("ry"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("dim"))
    half = F.col("dim") / 2
    return pts.crossJoin(F.broadcast(root)).select("point_id", geometry.in_square(F.col("x"), F.col("y"), F.col("rx"), F.col("ry") + half, half).alias("inside"))


@query(f"WITH {CUST}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM pts) SELECT point_id, round((x - a) / (b - a), 9) AS u, round((y - c) / (d - c), 9) AS v, round((z - e) * (1.0::DOUBLE / (f - e)), 9) AS h FROM pts, e")
def texture_coordinates(spark, d):
    """Places in a texture over the plane, and in one of heights."""
    pts = src.customers(spark, d)
    e = pts.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    u, v = geometry.texture_coordinates(F.col("x"), F.col("y"), tuple(F.col(n) for n in ("min_x", "min_y", "max_x", "max_y")))
    h = geometry.height_coordinate(F.col("z"), F.col("min_z"), F.col("max_z"))
    return pts.crossJoin(F.broadcast(e)).select("point_id", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"), F.round(h, 9).alias("h"))


@query(f"WITH {CELLS}, k AS (SELECT tile_row, tile_col, point_id, pow((qx - (mnx + tile_col * csx + csx / 2.0::DOUBLE)) / csx, 2) + pow((qy - (mny + tile_row * csy + csy / 2.0::DOUBLE)) / csy, 2) AS ratio FROM cells) SELECT tile_row, tile_col, arg_min(point_id, (ratio, point_id)) AS point_id, round(min(ratio), 9) AS ratio FROM k GROUP BY ALL")
def nearest_to_centre(spark, d):
    """The point of each tile that is nearest to its centre."""
    centre = lambda low, at, cs: F.col(low) + F.col(at) * F.col(cs) + F.col(cs) / 2.0
    ratio = geometry.ratio_to_centre(F.col("qx"), F.col("qy"), centre("mnx", "tile_col", "csx"), centre("mny", "tile_row", "csy"), F.col("csx"), F.col("csy"))
    best = order_cells(spark, d).groupBy("tile_row", "tile_col").agg(F.min(F.struct(ratio.alias("ratio"), "point_id")).alias("best"))
    return best.select("tile_row", "tile_col", "best.point_id", F.round("best.ratio", 9).alias("ratio"))


RINGS = "SELECT c_nationkey AS polygon, list(c_custkey::DOUBLE ORDER BY c_custkey * 7919 % 1009, c_custkey)[1:4] AS xs, list(c_acctbal ORDER BY c_custkey * 7919 % 1009, c_custkey)[1:4] AS ys FROM customer GROUP BY 1"
SIGNS = "[t FOR t IN [sign({v}[i % len({v}) + 1] - {v}[i]) FOR i IN range(1, len({v}) + 1)] IF t <> 0]"
CHANGES = "list_sum([CAST({s}[i % len({s}) + 1] <> {s}[i] AS INTEGER) FOR i IN range(1, len({s}) + 1)])"


@query(f"WITH r AS ({RINGS}), s AS (SELECT *, {SIGNS.format(v='xs')} AS sx, {SIGNS.format(v='ys')} AS sy FROM r) SELECT polygon, len(xs) >= 3 AND coalesce({CHANGES.format(s='sx')}, 0) <= 2 AND coalesce({CHANGES.format(s='sy')}, 0) <= 2 AS convex FROM s")
def convex_polygons(spark, d):
    """Which polygons, of four corners each, go back and forth at most once along each axis."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    row = F.struct((F.col("c_custkey") * 7919 % 1009).alias("o"), "c_custkey", "c_acctbal")
    rings = c.groupBy(F.col("c_nationkey").alias("polygon")).agg(F.slice(F.sort_array(F.collect_list(row)), 1, 4).alias("ring"))  # a nation's customers: a bounded list
    xs, ys = F.transform("ring", lambda p: p["c_custkey"].cast("double")), F.transform("ring", lambda p: p["c_acctbal"])
    return rings.select("polygon", geometry.convex_corners(xs, ys).alias("convex"))


@query("SELECT o_orderkey AS point_id, CAST(trunc(CAST((o_orderkey % 101) / 100.0::DOUBLE AS FLOAT) * CAST(300 AS FLOAT)) AS INTEGER) AS size FROM orders")
def ramp_sizes(spark, d):
    """The lengths of ramps for qualities from 0 to 100."""
    return src.orders(spark, d).select("point_id", records.ramp_size_of(F.col("point_id") % 101).alias("size"))


@query("SELECT o_orderkey AS point_id, CASE o_orderkey % 11 WHEN 2 THEN 20 WHEN 3 THEN 28 WHEN 5 THEN 28 WHEN 7 THEN 30 WHEN 8 THEN 30 WHEN 10 THEN 30 END AS rgb_offset FROM orders")
def rgb_offsets(spark, d):
    """Where colours begin in records of each format."""
    return src.orders(spark, d).select("point_id", las.rgb_offset(F.col("point_id") % 11).cast("int").alias("rgb_offset"))


@query("SELECT o_orderkey AS point_id, (o_orderkey & 1) = 1 AS gps_standard_time, ((o_orderkey >> 2) & 1) = 1 AS waveform_external, ((o_orderkey >> 3) & 1) = 1 AS synthetic_returns, ((o_orderkey >> 4) & 1) = 1 AS wkt FROM orders")
def encoding_bits(spark, d):
    return src.orders(spark, d).select("point_id", *las.encoding_bits(F.col("point_id")))


@query("SELECT c_custkey AS point_id, c_name[1:c_custkey % 9 + 1] AS name FROM customer")
def padded_text(spark, d):
    """Names from fields of fixed width, filled up with zeros."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    cut = F.substring("c_name", F.lit(1), F.col("c_custkey") % 9 + 1)
    return c.select(F.col("c_custkey").alias("point_id"), las.text_of(F.concat(cut, F.lit("\0\0"), F.lit("rest")).cast("binary")).alias("name"))


@query("SELECT o_orderkey AS point_id, CAST(o_orderkey % 256 & 31 AS INTEGER) AS classification, CAST(o_orderkey % 256 >> 5 & 1 AS INTEGER) AS synthetic, CAST(o_orderkey % 256 >> 6 & 1 AS INTEGER) AS key_point, CAST(o_orderkey % 256 >> 7 & 1 AS INTEGER) AS withheld FROM orders")
def las_class_bits(spark, d):
    """Class, synthetic, key and withheld flags of points read from files."""
    folder = scratch(spark, "las-classes")
    pts = src.orders(spark, d).select("qx", "qy", "qz", F.col("point_id").cast("double").alias("gps_time"), (F.col("point_id") % 256).cast("int").alias("class_bits"))
    las.write_las(pts, folder, src.Quantization((1.0, 0.01, 1.0))).write.format("noop").mode("overwrite").save()
    got = las.read_las(spark, folder, ("gps_time", "class_bits"))
    return got.select(F.col("gps_time").cast("bigint").alias("point_id"), *records.class_bits(F.col("class_bits")))


@query("SELECT count(*) AS points, count(*) AS places, 0 AS off FROM orders")
def las_indexed(spark, d):
    """Each point with the byte at which its record begins: as many places as points, all at whole records behind the header."""
    folder = las_orders(spark, d)
    got = las.read_las(spark, folder, ("path", "point_index", "byte_offset"))
    marked = got.select("path", (F.col("byte_offset") - F.col("point_index") * 36).alias("off"), "byte_offset", F.shiftright("byte_offset", 20).alias("part"))
    # Places are counted by parts of a megabyte, which are dealt to as many tasks as there are points for.
    n = las.headers(spark, folder).agg(F.sum("n_points")).first()[0] or 0
    parts = marked.repartition(-(-n // las.RANGE) + 1, "path", "part").groupBy("path", "part").agg(F.min("off").alias("low"), F.max("off").alias("high"), F.count_distinct("byte_offset").alias("places"), F.count("*").alias("points"))
    bounds = parts.groupBy("path").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("places").alias("places"), F.sum("points").alias("points"))
    return bounds.agg(F.sum("points").alias("points"), F.sum("places").alias("places"), F.sum((F.col("low") != F.col("high")).cast("int")).cast("int").alias("off"))


GEO = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)


def las_with_records(spark, d):
    folder = scratch(spark, "las-typed")
    pts = src.customers(spark, d).select("qx", "qy", "qz")
    extra = bytes(2) + bytes([4, 0]) + b"height".ljust(32, b"\0") + bytes(124) + b"above ground".ljust(32, b"\0")
    vlrs = [("LASF_Projection", 34735, "keys", GEO), ("LASF_Projection", 34736, "doubles", struct.pack("<2d", 1.5, -2.25)), ("LASF_Projection", 2112, "wkt", b'PROJCS["zone"]\0'), ("LASF_Spec", 0, "classes", bytes([2]) + b"ground".ljust(15, b"\0")), ("LASF_Spec", 4, "extra", extra)]
    las.write_las(pts.coalesce(1), folder, src.Quantization((1.0, 0.01, 1.0)), vlrs=vlrs, evlrs=[("tessera", 5, "first", b"one"), ("tessera", 5, "second", b"two")]).write.format("noop").mode("overwrite").save()
    return folder


@query("""SELECT * FROM (VALUES ('geo keys', 0, '1024', 1.0::DOUBLE, NULL), ('geo keys', 1, '3072', 32633.0, NULL), ('geo doubles', 0, NULL, 1.5, NULL), ('geo doubles', 1, NULL, -2.25, NULL),
 ('coordinate system WKT', 0, NULL, NULL, 'PROJCS["zone"]'), ('classification lookup', 0, NULL, 2.0, 'ground'), ('extra bytes', 0, 'height', 4.0, 'above ground')) t(known, item, name, number, text) WHERE (SELECT count(*) FROM customer) > 0""")
def las_typed_records(spark, d):
    """Payloads of public records, decoded, of files of customers."""
    return las.typed_records(spark, las_with_records(spark, d)).drop("path")


@query("SELECT 1 AS extended, 'first' AS description, 'one' AS data FROM customer LIMIT 1")
def las_record_lookup(spark, d):
    """The first record of an identifier; payloads of others aren't read."""
    return las.find_records(spark, las_with_records(spark, d), "tessera", 5).select("extended", "description", F.col("data").cast("string").alias("data"))


@query(f"WITH {PTS} SELECT count(*) AS n, min(qx) AS low, max(qx) AS high FROM pts")
def las_list_file(spark, d):
    """The points of a list file: paths, one of them missing, in a text."""
    folder = las_orders(spark, d)
    paths = [r.path for r in las.files(spark, folder).orderBy("path").collect()]
    lists = scratch(spark, "lists")
    spark.createDataFrame([(p,) for p in [*paths, f"{folder}/missing.las"]], "value string").coalesce(1).write.text(lists)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(lists).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.listStatus(hadoop(lists)) if s.getPath().getName().startswith("part-")]
    fs.rename(part, hadoop(f"{lists}/all.lasgroup"))
    return las.read_las(spark, f"{lists}/all.lasgroup", ("qx",)).agg(F.count("*").alias("n"), F.min("qx").cast("bigint").alias("low"), F.max("qx").cast("bigint").alias("high"))


@query("SELECT 'LAS 1.4, format 7, ' || count(*) || ' points' AS line FROM orders")
def las_preview(spark, d):
    """The kind of the files and their points, from headers alone."""
    heads = las.headers(spark, las_orders(spark, d))
    lines = las.preview(spark, las_orders(spark, d)).select(F.regexp_extract("line", "^(LAS [0-9.]+, format [0-9]+)", 1).alias("kind")).distinct()
    return lines.crossJoin(heads.agg(F.sum("n_points").alias("n"))).select(F.concat("kind", F.lit(", "), F.col("n").cast("string"), F.lit(" points")).alias("line"))


@query("SELECT o_orderkey AS point_id, CAST(o_custkey AS INTEGER) AS qx FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i // 512 IN (1, 2, 5)")
def las_sparse_scan(spark, d):
    """Three chunks of a set of files in order, of which only the ranges of their runs are read."""
    folder = scratch(spark, "las-sparse")
    pts = src.orders(spark, d).select("qx", "qy", "qz", F.col("point_id").cast("double").alias("gps_time")).repartitionByRange("gps_time").sortWithinPartitions("gps_time")
    las.write_las(pts, folder, src.Quantization((1.0, 0.01, 1.0))).write.format("noop").mode("overwrite").save()
    chunks = spark.createDataFrame([(1,), (2,), (5,)], "chunk_id long")
    # Files bear the numbers of their tasks, so their names are in the order of points; a run may go on in the next file.
    files = running_sums(las.headers(spark, folder).select("path", "n_points"), ["path"], {"first": F.col("n_points")})
    runs = grid.runs(chunks, "chunk_id").select((F.col("start") * 512).alias("low"), ((F.col("start") + F.col("length")) * 512).alias("high"))
    met = files.join(F.broadcast(runs), (F.col("low") < F.col("first") + F.col("n_points")) & (F.col("high") > F.col("first")))
    start = F.greatest(F.col("low") - F.col("first"), F.lit(0))
    inside = met.select("path", start.alias("start"), (F.least(F.col("high") - F.col("first"), F.col("n_points")) - start).alias("n"))
    return las.read_las(spark, folder, ("gps_time", "qx"), inside).select(F.col("gps_time").cast("bigint").alias("point_id"), "qx")


#: Tiled sets that this process has written, by application and tables.
TILED_SETS: dict[tuple, str] = {}


def tiled_las(spark, d):
    key = spark.sparkContext.applicationId, d
    if key not in TILED_SETS:
        folder = scratch(spark, "las-tiled")
        pts = src.orders(spark, d).select("qx", "qy", "qz", F.col("point_id").cast("double").alias("gps_time"))
        lasformat.write_tiled_las(pts, CELL, folder, src.Quantization((1.0, 0.01, 1.0)))
        TILED_SETS[key] = folder
    lasformat.register(spark)
    return TILED_SETS[key]


@query(f"WITH {CELLS} SELECT point_id, qx, tile_row, tile_col FROM cells WHERE tile_row = 3 AND tile_col BETWEEN 2 AND 4 AND qx > 350")
def las_tile_read(spark, d):
    """Points of some tiles of a tiled set, by the data source: only their ranges are read."""
    df = spark.read.format("las").option("fields", "gps_time,qx,tile_row,tile_col").load(tiled_las(spark, d))
    found = df.where("tile_row = 3 and tile_col >= 2 and tile_col <= 4 and qx > 350")
    return found.select(F.col("gps_time").cast("bigint").alias("point_id"), F.col("qx").cast("bigint").alias("qx"), "tile_row", "tile_col")


@query(f"WITH {CELLS}, n AS (SELECT tile_row, tile_col, count(*) AS point_count FROM cells GROUP BY ALL) SELECT *, CAST(coalesce(sum(point_count) OVER (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS point_offset FROM n")
def las_tile_set(spark, d):
    """The tiles of a tiled set and where their points begin in it, from its record file."""
    rows = lasformat.tile_set(spark, tiled_las(spark, d))
    return rows.groupBy("tile_row", "tile_col").agg(F.sum("point_count").alias("point_count"), F.min("point_offset").alias("point_offset"))


@query("SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders")
def las_by_extension(spark, d):
    """Files of a folder, each opened by the handler of its extension."""
    lasformat.register(spark)
    folder = scratch(spark, "las-handlers")
    src.orders(spark, d).select("qx", "qy", "qz").write.format("las").option("scale", "1,0.01,1").mode("append").save(folder)
    found = None
    for uri, _ in lasformat.listing(folder):
        one = lasformat.open_points(spark, uri).select("x")
        found = one if found is None else found.union(one)
    return found.agg(F.count("*").alias("n"), F.sum("x").cast("bigint").alias("total"))


#: Folders of compressed files that this process has written, by application and tables.
COMPRESSED: dict[tuple, str] = {}


def laz_orders(spark, d):
    """Orders as compressed files of format 3, in chunks of 2000 points."""
    key = spark.sparkContext.applicationId, d
    if key not in COMPRESSED:
        folder = scratch(spark, "laz")
        colours = [(F.col("point_id") * k % 65536).cast("int").alias(c) for c, k in (("red", 7), ("green", 7), ("blue", 11))]
        pts = src.orders(spark, d).select("qx", "qy", "qz", F.col("point_id").cast("double").alias("gps_time"), (F.col("point_id") % 5).cast("int").alias("intensity"), *colours)
        # Coding is costly: many tasks, as points are many and not bytes, each with neighbours in time.
        pts = pts.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-pts.count() // laz.CHUNK)), "gps_time")
        laz.write_laz(pts, folder, src.Quantization((1.0, 0.01, 1.0)), 3, 2000).write.format("noop").mode("overwrite").save()
        COMPRESSED[key] = folder
    return COMPRESSED[key]


@query(f"WITH {PTS} SELECT point_id, qx, qy, qz, CAST(point_id % 5 AS INTEGER) AS intensity, CAST(point_id * 7 % 65536 AS INTEGER) AS red, CAST(point_id * 7 % 65536 AS INTEGER) AS green, CAST(point_id * 11 % 65536 AS INTEGER) AS blue FROM pts")
def laz_points(spark, d):
    """Points of compressed files, decoded chunk by chunk."""
    got = laz.read_laz(spark, laz_orders(spark, d), ("gps_time", "qx", "qy", "qz", "intensity", "red", "green", "blue"))
    return got.select(F.col("gps_time").cast("bigint").alias("point_id"), *[F.col(c).cast("bigint").alias(c) for c in ("qx", "qy", "qz")], "intensity", "red", "green", "blue")


@query("SELECT o_orderkey AS point_id, CAST(o_custkey AS INTEGER) AS qx FROM orders WHERE o_custkey > 350 AND o_orderkey % 5 = 3")
def laz_pushed(spark, d):
    """Points of compressed files by the data source, with filters that it compares itself."""
    lasformat.register(spark)
    df = spark.read.format("las").option("fields", "gps_time,qx,intensity").load(laz_orders(spark, d))
    return df.where("qx > 350 and intensity = 3").select(F.col("gps_time").cast("bigint").alias("point_id"), "qx")


@query("SELECT count(*) AS points, 0::BIGINT AS gaps, 0::BIGINT AS longer FROM orders")
def laz_chunks(spark, d):
    """The points that the chunk tables of compressed files name; chunks that don't begin where the one before ends, or hold more than 2000 points."""
    before = Window.partitionBy("path").orderBy("start")
    found = laz.chunks(spark, laz_orders(spark, d))
    gap = F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("n")).over(before), F.lit(0))
    return found.select("n", gap.alias("gap")).agg(F.sum("n").alias("points"), F.count_if("gap").alias("gaps"), F.count_if(F.col("n") > 2000).alias("longer"))


@query("SELECT count(*) FILTER (o_orderkey % 2 = 0) AS first_run, count(*) AS both FROM orders")
def las_file_queue(spark, d):
    """A stream of files: what lies in a folder, then what it has gained."""
    lasformat.register(spark)
    folder, state = scratch(spark, "las-queue"), scratch(spark, "las-queue-state")
    pts = src.orders(spark, d)
    put = lambda rows: rows.select("qx", "qy", "qz").write.format("las").option("scale", "1,0.01,1").mode("append").save(folder)
    put(pts.where("point_id % 2 = 0"))
    first = lasformat.stream_counts(spark, folder, state).agg(F.sum("n")).first()[0]
    put(pts.where("point_id % 2 = 1"))
    return lasformat.stream_counts(spark, folder, state).agg(F.lit(first).cast("bigint").alias("first_run"), F.sum("n").alias("both"))


def text_of_customers(spark, d):
    path = scratch(spark, "xyz-lines")
    c = src.customers(spark, d)
    number = lambda name: F.format_string("%.2f", name)
    line = F.when(F.col("point_id") % 10 == 3, F.lit("no point")).otherwise(F.concat_ws(" ", number("x"), number("y"), number("z"), F.lit("more")))
    c.select(line.alias("value")).write.text(path)
    return path


@query("SELECT min(c_custkey)::DOUBLE AS min_x, max(c_custkey)::DOUBLE AS max_x, min(round(c_acctbal, 2)) AS min_y, max(round(c_acctbal, 2)) AS max_y, min(c_nationkey)::DOUBLE AS min_z, max(c_nationkey)::DOUBLE AS max_z, count(*) AS n_points, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) AS skipped FROM customer WHERE c_custkey % 10 <> 3")
def xyz_summary(spark, d):
    """Extent, number of points and of skipped lines of a text."""
    return xyz.summary(spark, text_of_customers(spark, d))


@query("SELECT c_custkey::DOUBLE AS x, round(c_acctbal, 2) AS y, c_nationkey::DOUBLE AS z FROM customer WHERE c_custkey % 10 <> 3")
def xyz_strict(spark, d):
    """The points of lines that begin with three numbers with points in them."""
    return xyz.read_strict(spark, text_of_customers(spark, d), 10**9)


@query(f"WITH {CUST} SELECT x, y, z FROM pts")
def xyz_binary(spark, d):
    """Points written as triples of doubles and read again."""
    folder = scratch(spark, "xyz-binary")
    xyz.write_binary(src.customers(spark, d), folder).write.format("noop").mode("overwrite").save()
    return xyz.read_binary(spark, folder)


BY_ASPECT = f"{PTS}, e AS (SELECT min(qx) AS ax, max(qx) AS bx, min(qy) AS ay, max(qy) AS b_, max(x) - min(x) AS w, (max(y) - min(y)) / 100 AS h FROM pts), s AS (SELECT *, CASE WHEN w >= h THEN 1000 ELSE CAST(ceil(1000 * (w / h)) AS BIGINT) END AS nc, CASE WHEN w >= h THEN CAST(ceil(1000 / (w / h)) AS BIGINT) ELSE 1000 END AS nr FROM e)"


@query(f"WITH {BY_ASPECT} SELECT least((qy - ay) * nr // greatest(b_ - ay, 1), nr - 1) AS py, least((qx - ax) * nc // greatest(bx - ax, 1), nc - 1) AS px, max(qz) AS qz FROM pts, s GROUP BY 1, 2")
def preview_by_aspect(spark, d):
    """The highest point of each pixel of a preview whose longer side has 1000, the other as the extent asks."""
    pts = src.orders(spark, d)
    e = pts.agg(F.min("qx").alias("ax"), F.max("qx").alias("bx"), F.min("qy").alias("ay"), F.max("qy").alias("b"), (F.max("x") - F.min("x")).alias("w"), ((F.max("y") - F.min("y")) / 100).alias("h"))
    columns, rows = grid.raster_size(F.col("w"), F.col("h"), 1000)
    sized = e.select("*", columns.cast("bigint").alias("nc"), rows.cast("bigint").alias("nr"))
    at = lambda q, low, high, n: F.least(F.expr(f"({q} - {low}) * {n} div greatest({high} - {low}, 1)"), F.col(n) - 1)
    return pts.crossJoin(F.broadcast(sized)).groupBy(at("qy", "ay", "b", "nr").alias("py"), at("qx", "ax", "bx", "nc").alias("px")).agg(F.max("qz").alias("qz"))


@query(f"WITH {LINE}, e AS (SELECT min(qx) AS ax, min(qy) AS ay, min(z) AS mz FROM pts), k AS (SELECT (qy - ay) // 10 AS r, (qx - ax) // 50 AS c, max(qz) AS q, max(mz) AS mz FROM pts, e GROUP BY 1, 2) SELECT r, c, round(q * 0.01::DOUBLE - mz, 6) AS height FROM k")
def heights_above_minimum(spark, d):
    """A raster's quantized heights as real ones above the lowest point; cells without points stay out."""
    pts = src.lineitems(spark, d)
    e = pts.agg(F.min("qx").alias("ax"), F.min("qy").alias("ay"), F.min("z").alias("mz"))
    cells = pts.crossJoin(F.broadcast(e)).groupBy(F.expr("(qy - ay) div 10").alias("r"), F.expr("(qx - ax) div 50").alias("c")).agg(F.max("qz").alias("q"), F.max("mz").alias("mz"))
    return cells.select("r", "c", F.round(quantize.dequantize(F.col("q"), 0.01, 0.0) - F.col("mz"), 6).alias("height"))


RASTER = f"{CUST}, e AS (SELECT min(qx) AS ax, max(qx) AS bx, min(qy) AS ay, max(qy) AS b_ FROM pts), px AS (SELECT least((qy - ay) * 24 // greatest(b_ - ay, 1), 23) AS r, least((qx - ax) * 32 // greatest(bx - ax, 1), 31) AS c, max(qz) AS q FROM pts, e GROUP BY 1, 2)"


@query(f"WITH {RASTER}, b AS (SELECT r, c, least(CAST(floor(q / 24.0::DOUBLE * 60) AS INTEGER), 59) AS bin FROM px), p AS (SELECT r, c, bin / 59.0::DOUBLE * 3 AS p FROM b), k AS (SELECT r, c, p, least(CAST(floor(p) AS INTEGER), 2) AS k FROM p), col AS (SELECT r, c, {ramp_sql(0)} * 65536 + {ramp_sql(1)} * 256 + {ramp_sql(2)} AS rgb FROM k), every AS (SELECT CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM range(32) a(x), range(24) b(y)) SELECT px, py, CASE WHEN rgb IS NULL THEN 16777215 ELSE rgb::BIGINT + 4278190080 END AS argb FROM every LEFT JOIN col ON c = px AND 23 - r = py")
def bitmap(spark, d):
    """A raster as a picture: the first row lowest, pixels without points transparent."""
    pts = src.customers(spark, d)
    e = pts.agg(F.min("qx").alias("ax"), F.max("qx").alias("bx"), F.min("qy").alias("ay"), F.max("qy").alias("b"))
    at = lambda q, low, high, n: F.least(F.expr(f"({q} - {low}) * {n} div greatest({high} - {low}, 1)"), F.lit(n - 1))
    pixels = pts.crossJoin(F.broadcast(e)).groupBy(at("qy", "ay", "b", 24).alias("r"), at("qx", "ax", "bx", 32).alias("c")).agg(F.max("qz").alias("q"))
    return records.bitmap(pixels, 32, 24, records.cached_ramp(STOPS, 60), records.interval(F.col("q"), F.lit(0), F.lit(24), 60))


DIFFERENCES = "o AS (SELECT q, lag(q) OVER (ORDER BY q) AS p FROM v), d AS (SELECT q - p AS d, count(*) AS n FROM o WHERE q > p GROUP BY 1)"


@query(f"WITH v AS (SELECT CAST(trunc(o_totalprice) AS BIGINT) * 100 + 7 AS q FROM orders), {DIFFERENCES}, k AS (SELECT CASE WHEN max(CAST(d % 1000 <> 0 AS INTEGER)) = 0 THEN 3 WHEN max(CAST(d % 100 <> 0 AS INTEGER)) = 0 THEN 2 WHEN max(CAST(d % 10 <> 0 AS INTEGER)) = 0 THEN 1 ELSE 0 END AS k, round(sum(ln(d) / ln(10) * n) / sum(n), 3) AS m FROM d) SELECT round(pow(10.0::DOUBLE, k - 3), 9) AS common, round(CASE WHEN floor(m) > 0 AND floor(m) < 3 THEN pow(10.0::DOUBLE, floor(m) - 3) ELSE 0.001 END, 9) AS typical FROM k")
def scale_from_data(spark, d):
    """The coarsest scale that keeps prices whole, planted in hundreds of a finer one, and the one that typical differences ask for."""
    values = src.orders(spark, d).select((F.expr("bigint(y)") * 100 + 7).alias("q"))
    differences = scales.neighbour_differences(values, "q")
    common, typical = scales.common_scale(differences, 0.001), scales.typical_scale(differences, 0.001)
    return common.select(F.round("scale", 9).alias("common")).crossJoin(typical.select(F.round("scale", 9).alias("typical")))


@query(f"WITH {PTS} SELECT point_id, CAST(trunc(qy * (0.01::DOUBLE / 0.25::DOUBLE) + (0.0::DOUBLE - 100.0::DOUBLE) / 0.25::DOUBLE) AS BIGINT) AS q FROM pts")
def requantized(spark, d):
    return src.orders(spark, d).select("point_id", scales.requantized(F.col("qy"), 0.01, 0.0, 0.25, 100.0).alias("q"))


@query(f"WITH {PTS} SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS i FROM pts) WHERE i < {16777216 // 12}")
def precision_sample(spark, d):
    """The first points that fit the memory set for tests of precision, 12 bytes each."""
    most = PRECISION_BYTES.get(spark) // 12
    return numbered(src.orders(spark, d).select("point_id"), ["point_id"]).where(F.col("position") < most).select("point_id")


@query(f"WITH {CUST}, u AS (SELECT DISTINCT qx, qy FROM pts), h AS (SELECT count(*) AS n FROM u) SELECT n AS places, 0 AS crossed FROM h")
def delaunay_places(spark, d):
    """Every place is a corner of the triangulation, and no triangle turns right."""
    faces = delaunay.delaunay(src.customers(spark, d), 500)
    corners = faces.select(F.explode(F.array(*[F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "abc"])).alias("p")).select("p.x", "p.y").distinct()
    turned = geometry.turn(*[F.col(f"{p}{v}") for p in "abc" for v in "xy"])
    return corners.agg(F.count("*").alias("places")).crossJoin(faces.agg(F.count_if(turned <= 0).cast("int").alias("crossed")))
