"""Registered queries of triangulation, stitched tiles, the quadtree index and greedy segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budget, delaunay, grid, segments, stitch, surface, treeindex
from tessera.operators.ordered import numbered
from tessera.plans.catalogue import CELLS, CUST, DENSITY, LEAF, LEVELS, SEG, order_cells, query, surface_cells
from tessera.sources import points as src


@query(None)
def delaunay_triangles(spark, d):
    """The triangulation of customers; no SQL can state it (see tests/test_delaunay.py)."""
    return delaunay.delaunay(src.customers(spark, d))


@query(f"WITH {CUST}, u AS (SELECT DISTINCT qx, qy FROM pts) SELECT a.qx, a.qy, min((a.qx - b.qx) * (a.qx - b.qx) + (a.qy - b.qy) * (a.qy - b.qy)) AS nearest FROM u a JOIN u b ON a.qx <> b.qx OR a.qy <> b.qy GROUP BY 1, 2")
def delaunay_nearest(spark, d):
    """The squared distance from each place to the nearest other one, which is always at the end of an edge of the triangulation."""
    faces = delaunay.delaunay(src.customers(spark, d), 400)
    ends = [(a, b) for a in "abc" for b in "abc" if a != b]
    edges = faces.select(F.explode(F.array(*[F.struct(*[F.col(f"{p}{v}").alias(n) for p, v, n in ((a, "x", "qx"), (a, "y", "qy"), (b, "x", "ox"), (b, "y", "oy"))]) for a, b in ends])).alias("e")).select("e.*")
    dx, dy = F.col("qx") - F.col("ox"), F.col("qy") - F.col("oy")
    return edges.groupBy("qx", "qy").agg(F.min(dx * dx + dy * dy).alias("nearest"))


SIDES = f"{DENSITY}, sides AS (SELECT tile_row, tile_col, CASE WHEN n >= 100 THEN 7 WHEN n >= 60 THEN 4 ELSE 3 END AS side, min_qz AS fill FROM dens)"


def tile_sides(spark, d):
    """A raster side for each tile by its points, and the height of pixels without one."""
    side = F.when(F.col("n") >= 100, 7).when(F.col("n") >= 60, 4).otherwise(3)
    return grid.density(order_cells(spark, d)).select("tile_row", "tile_col", side.alias("side"), F.col("min_qz").alias("fill"))


@query(f"""WITH {SIDES}, seen AS (SELECT c.tile_row, c.tile_col, least((qy - mny - c.tile_row * csy) * side // csy, side - 1) AS py, least((qx - mnx - c.tile_col * csx) * side // csx, side - 1) AS px, max(qz) AS top FROM cells c JOIN sides USING (tile_row, tile_col) GROUP BY ALL),
 every AS (SELECT tile_row, tile_col, fill, py, unnest(range(0, side)) AS px FROM (SELECT *, unnest(range(0, side)) AS py FROM sides))
 SELECT tile_row, tile_col, (((tile_row << 16) | tile_col) << 20) | (py << 10) | px AS vertex, CAST(py AS INTEGER) AS py, CAST(px AS INTEGER) AS px, coalesce(top, fill) AS qz FROM every LEFT JOIN seen USING (tile_row, tile_col, py, px)""")
def tile_vertices(spark, d):
    """The vertices of tiles whose rasters are of different sides."""
    return stitch.tile_vertices(order_cells(spark, d), tile_sides(spark, d))


def strip_sql(kind: str) -> str:
    left = kind == "left"
    own, other = ("(own << 20) | (k << 10)", "(near << 20) | (k << 10) | m") if left else ("(own << 20) | k", "(near << 20) | (m << 10) | k")
    at = lambda text, k: text.replace("k", f"({k})")
    return f"""SELECT '{kind}' AS kind, {at(other, 'i')} AS a, {at(other, 'i + 1')} AS b, {at(own, 'greatest((i + 1) * n + m - 1, 0) // m - 1')} AS c FROM (SELECT *, unnest(range(0, m)) AS i FROM {kind}s)
 UNION ALL SELECT '{kind}', {at(own, 'j')}, {at(own, 'j + 1')}, {at(other, '(j + 1) * m // n')} FROM (SELECT *, unnest(range(0, n)) AS j FROM {kind}s)"""


STITCHED = f"""{SIDES}, t AS (SELECT tile_row AS r, tile_col AS c, side - 1 AS n, (tile_row << 16) | tile_col AS id FROM sides),
 inners AS (SELECT id, y, unnest(range(0, n)) AS x FROM (SELECT *, unnest(range(0, n)) AS y FROM t)),
 lefts AS (SELECT t.id AS own, t.n, o.id AS near, o.n AS m FROM t JOIN t o ON o.r = t.r AND o.c = t.c - 1), tops AS (SELECT t.id AS own, t.n, o.id AS near, o.n AS m FROM t JOIN t o ON o.r = t.r - 1 AND o.c = t.c),
 corners AS (SELECT (d.id << 20) | (d.n << 10) | d.n AS d, (u.id << 20) | (u.n << 10) AS u, (l.id << 20) | l.n AS l, t.id << 20 AS t FROM t JOIN t d ON d.r = t.r - 1 AND d.c = t.c - 1 JOIN t u ON u.r = t.r - 1 AND u.c = t.c JOIN t l ON l.r = t.r AND l.c = t.c - 1),
 faces AS (SELECT 'inner' AS kind, (id << 20) | (y << 10) | x AS a, (id << 20) | (y << 10) | (x + 1) AS b, (id << 20) | ((y + 1) << 10) | x AS c FROM inners
 UNION ALL SELECT 'inner', (id << 20) | ((y + 1) << 10) | x, (id << 20) | (y << 10) | (x + 1), (id << 20) | ((y + 1) << 10) | (x + 1) FROM inners
 UNION ALL {strip_sql('left')} UNION ALL {strip_sql('top')} UNION ALL SELECT 'corner', d, u, l FROM corners UNION ALL SELECT 'corner', l, u, t FROM corners)"""


@query(f"WITH {STITCHED} SELECT kind, a, b, c FROM faces")
def tile_stitching(spark, d):
    """The triangles of all tiles and of the strips and corners between them."""
    return stitch.stitched(tile_sides(spark, d))


@query(f"""WITH {STITCHED}, e AS (SELECT unnest([[a, b], [b, c], [c, a]]) AS e FROM faces), k AS (SELECT least(e[1], e[2]) AS p, greatest(e[1], e[2]) AS q, count(*) AS n FROM e GROUP BY 1, 2),
 gap AS (SELECT (a.tile_row << 16) | a.tile_col AS id FROM dens a WHERE (SELECT count(*) FROM dens b WHERE abs(a.tile_row - b.tile_row) <= 1 AND abs(a.tile_col - b.tile_col) <= 1) = 9)
 SELECT CAST(n AS BIGINT) AS faces, count(*) AS edges FROM k WHERE (p >> 20) IN (SELECT id FROM gap) AND (q >> 20) IN (SELECT id FROM gap) GROUP BY n""")
def open_edges(spark, d):
    """How many faces the edges between and inside surrounded tiles have: two, every one."""
    sides = tile_sides(spark, d)
    around = sides.withColumn("dr", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dc", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    met = around.select((F.col("tile_row") + F.col("dr")).alias("tile_row"), (F.col("tile_col") + F.col("dc")).alias("tile_col")).groupBy("tile_row", "tile_col").agg(F.count("*").alias("k")).where("k = 9")
    inner = met.join(sides, ["tile_row", "tile_col"], "left_semi").select(grid.packed_id(F.col("tile_row"), F.col("tile_col")).alias("id"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    edges = stitch.stitched(sides).select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).groupBy("e.p", "e.q").agg(F.count("*").alias("faces"))
    for end in ("p", "q"):
        edges = edges.withColumn("id", F.shiftright(end, 20)).join(inner, "id", "left_semi").drop("id")
    return edges.groupBy("faces").agg(F.count("*").alias("edges"))


NODES, LEAST, RECORD, BYTES = 400, 12, 28, 2000
REDUCED = f"""{LEAF}, par AS (SELECT depth, path, n, path[1:depth - 1] AS up FROM nodes), kid AS (SELECT depth - 1 AS depth, up AS path, count(*) AS kids FROM par WHERE depth > 0 GROUP BY ALL),
 ordered AS (SELECT k.depth, k.path, coalesce(sum(kids) OVER (ORDER BY k.depth DESC, n, k.path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM kid k JOIN nodes USING (depth, path)),
 ended AS (SELECT depth, path FROM ordered, (SELECT count(*) AS total FROM nodes) WHERE total > {NODES} AND total - gone > {NODES - int(0.2 * NODES)}),
 kept AS (SELECT p.depth, p.path, p.n, p.up, e.path IS NOT NULL AS final FROM par p LEFT JOIN ended e ON e.depth = p.depth AND e.path = p.path WHERE NOT EXISTS (SELECT 1 FROM ended u WHERE u.depth = p.depth - 1 AND u.path = p.up)),
 ends AS (SELECT k.depth, k.path, k.n FROM kept k WHERE k.depth > 0 AND (k.n < {LEAST} OR NOT EXISTS (SELECT 1 FROM kept j WHERE j.depth = k.depth + 1 AND j.up = k.path)) AND EXISTS (SELECT 1 FROM kept j WHERE j.depth = k.depth - 1 AND j.path = k.up AND (j.n >= {LEAST} OR j.depth = 0))),
 placed AS (SELECT c.path AS cell, unnest([point_id * {RECORD} // {BYTES}, (point_id * {RECORD} + {RECORD} - 1) // {BYTES}]) AS chunk FROM (SELECT point_id, """ + " || ".join(
    f"CAST(((cy >> {LEVELS - 1 - i}) & 1) * 2 + ((cx >> {LEVELS - 1 - i}) & 1) AS VARCHAR)" for i in range(LEVELS)
) + f""" AS path FROM (SELECT point_id, CAST(least(floor((x - rx) / dim * {1 << LEVELS}), {(1 << LEVELS) - 1}) AS BIGINT) AS cx, CAST(least(floor((y - ry) / dim * {1 << LEVELS}), {(1 << LEVELS) - 1}) AS BIGINT) AS cy FROM pts, root)) c),
 sets AS (SELECT path, depth, count(DISTINCT chunk) AS chunks FROM ends JOIN placed ON cell[1:depth] = path GROUP BY ALL)"""


def reduced_nodes(spark, d):
    return treeindex.reduced(surface.quadtree(src.customers(spark, d), LEVELS), NODES)


def leaf_chunks(spark, d):
    """The leaves of the reduced tree, and the bitmaps of their chunks."""
    ends = treeindex.leaves(reduced_nodes(spark, d), LEAST)
    placed = treeindex.with_paths(src.customers(spark, d), LEVELS)
    return ends, treeindex.chunk_bitmaps(placed, treeindex.point_chunks(F.col("point_id") * RECORD, RECORD, BYTES), ends, LEVELS)


@query(f"WITH {REDUCED} SELECT depth, path, n, final FROM kept")
def quadtree_reduced(spark, d):
    """The tree when inner nodes are collapsed until a budget of nodes holds."""
    return reduced_nodes(spark, d)


@query(f"WITH {REDUCED} SELECT depth, path, n, chunks FROM ends JOIN sets USING (depth, path)")
def quadtree_leaf_chunks(spark, d):
    """The leaves with the number of chunks that hold their points."""
    ends, bitmaps = leaf_chunks(spark, d)
    return ends.join(treeindex.set_sizes(bitmaps), "path")


@query(f"WITH {REDUCED} SELECT path[1:1] AS path, count(DISTINCT chunk) AS chunks FROM ends JOIN placed ON cell[1:depth] = path GROUP BY 1")
def quadtree_chunk_union(spark, d):
    """The united chunk sets of each quadrant, from the bitmaps of its leaves."""
    _, bitmaps = leaf_chunks(spark, d)
    return treeindex.set_sizes(treeindex.united(bitmaps, F.substring("path", 1, 1)))


def map_sql(value: str, source: str) -> str:
    digit = lambda i: f"CAST(path[{i + 1}:{i + 1}] AS INTEGER)"
    corner = lambda mask, div: " + ".join(f"CASE WHEN depth > {i} THEN ({digit(i)} // {div}) % 2 * {1 << (LEVELS - 1 - i)} ELSE 0 END" for i in range(LEVELS))
    at = lambda place, side: f"least(floor(({place}) * {side} / {1 << LEVELS}.0::DOUBLE), {side} - 1)::BIGINT"
    return f"""m AS (SELECT greatest(1, CASE WHEN w / h < 1 THEN floor(64 * (w / h)) ELSE 64 END)::BIGINT AS width, greatest(1, CASE WHEN w / h > 1 THEN floor(64 / (w / h)) ELSE 64 END)::BIGINT AS height FROM (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts)),
 foot AS (SELECT {corner(0, 1)} AS x, {corner(0, 2)} AS y, {1 << LEVELS} >> depth AS span, {value} AS value, width, height FROM {source}, m),
 spread AS (SELECT r, value, unnest(range({at('x', 'width')}, {at('x + span', 'width')})) AS c FROM (SELECT *, unnest(range({at('y', 'height')}, {at('y + span', 'height')})) AS r FROM foot)), seen AS (SELECT r, c, max(value) AS value FROM spread GROUP BY 1, 2)"""


@query(f"WITH {REDUCED}, {map_sql('depth', 'ends')} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, value AS depth FROM seen")
def quadtree_depth_map(spark, d):
    ends = treeindex.leaves(reduced_nodes(spark, d), LEAST)
    return treeindex.footprint_map(ends, F.col("depth"), treeindex.map_size(src.customers(spark, d)), LEVELS).withColumnRenamed("value", "depth")


@query(f"WITH {REDUCED}, {map_sql('chunks', 'sets')} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 9 * value // (SELECT max(chunks) FROM sets) AS shade FROM seen")
def quadtree_chunk_map(spark, d):
    """How many chunks the leaf over each pixel needs, of nine steps to the most of any leaf."""
    ends, bitmaps = leaf_chunks(spark, d)
    sized = ends.join(treeindex.set_sizes(bitmaps), "path")
    seen = treeindex.footprint_map(sized, F.col("chunks"), treeindex.map_size(src.customers(spark, d)), LEVELS)
    return seen.crossJoin(F.broadcast(sized.agg(F.max("chunks").alias("most")))).select("r", "c", F.expr("9 * value div most").alias("shade"))


FINE, BUDGET, RUN = (70, 3_300_000), 1500, 200
GREEDY = f"""{CELLS}, fine AS (SELECT (qy - mny) // {FINE[1]} AS fr, (qx - mnx) // {FINE[0]} AS fc, count(*) AS n FROM cells GROUP BY 1, 2), big AS (SELECT DISTINCT tile_row, tile_col FROM cells),
 tiles AS (SELECT tile_row, tile_col, row_number() OVER (ORDER BY tile_row, tile_col) - 1 AS position FROM big),
 cover AS (SELECT position, fr * 65536 + fc AS cell, n FROM tiles JOIN fine ON fr * {FINE[1]} < (tile_row + 1) * 5000000 AND (fr + 1) * {FINE[1]} > tile_row * 5000000 AND fc * {FINE[0]} < (tile_col + 1) * 100 AND (fc + 1) * {FINE[0]} > tile_col * 100),
 pair AS (SELECT s.position AS s, c.cell, min(c.position) AS p, max(c.n) AS n FROM tiles s JOIN cover c ON c.position >= s.position GROUP BY 1, 2), step AS (SELECT s, p, sum(n) AS n FROM pair GROUP BY 1, 2),
 total AS (SELECT s, p, sum(n) OVER (PARTITION BY s ORDER BY p) AS t FROM step), nxt AS (SELECT s, coalesce(min(p) FILTER (WHERE t > {BUDGET} AND p > s), (SELECT count(*) FROM tiles)) AS e FROM total GROUP BY s)"""
CHAIN = """chain(s) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT CAST(e AS BIGINT) FROM chain JOIN nxt USING (s) WHERE e < (SELECT count(*) FROM tiles)), seg AS (SELECT position, tile_row, tile_col, (SELECT count(*) FROM chain WHERE s <= position) - 1 AS segment FROM tiles)"""


def greedy(spark, d):
    """Segments of tiles in row-major order, over the counts of a grid that isn't aligned with them; what covers a tile; chunks of cells."""
    cells = order_cells(spark, d)
    fine = cells.select(F.expr(f"(qy - mny) div {FINE[1]}").alias("fr"), F.expr(f"(qx - mnx) div {FINE[0]}").alias("fc"), grid.quotient(F.col("point_id"), RUN).alias("chunk"))
    cell = (F.col("fr") * 65536 + F.col("fc")).alias("cell")
    counts = fine.groupBy(cell).agg(F.count("*").alias("n"))
    tiles = numbered(cells.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"]).drop("total")
    across = lambda at, size, step: F.sequence(F.floor(F.col(at) * size / step).cast("bigint"), (F.ceil((F.col(at) + 1) * size / step) - 1).cast("bigint"))
    spread = tiles.withColumn("fr", F.explode(across("tile_row", 5_000_000, FINE[1]))).withColumn("fc", F.explode(across("tile_col", 100, FINE[0])))
    cover = spread.select("position", cell).join(counts, "cell").select("position", "cell", "n")
    return budget.greedy_segments(tiles, cover, BUDGET), cover, fine.select(cell, "chunk").distinct()


@query(f"WITH RECURSIVE {GREEDY}, {CHAIN}, once AS (SELECT segment, cell, min(position) AS position, max(n) AS n FROM seg JOIN cover USING (position) GROUP BY 1, 2), fresh AS (SELECT position, sum(n) AS n FROM once GROUP BY 1) SELECT position, tile_row, tile_col, segment, CAST(coalesce(sum(n) OVER (PARTITION BY segment ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM seg LEFT JOIN fresh USING (position)")
def greedy_segments(spark, d):
    return greedy(spark, d)[0]


@query(f"WITH RECURSIVE {GREEDY}, {CHAIN}, wanted AS (SELECT DISTINCT segment, point_id // {RUN} AS chunk FROM seg JOIN cover USING (position) JOIN cells k ON (k.qy - k.mny) // {FINE[1]} * 65536 + (k.qx - k.mnx) // {FINE[0]} = cell), i AS (SELECT segment, chunk, chunk - row_number() OVER (PARTITION BY segment ORDER BY chunk) AS island FROM wanted) SELECT segment, min(chunk) AS start, count(*) AS length FROM i GROUP BY segment, island")
def segment_chunk_runs(spark, d):
    """The runs of chunks that each segment reads."""
    return budget.segment_runs(*greedy(spark, d))


SPRITES = f"{CUST}, n AS (SELECT row_number() OVER (ORDER BY point_id) - 1 AS i, * FROM pts), kept AS (SELECT * FROM n WHERE i % 3 = 0)"


def sprites(spark, d):
    """Squares of side 5 for every third customer."""
    points = numbered(src.customers(spark, d).select("point_id", "x", "y", "z"), ["point_id"])
    return surface.point_sprites(points, "position", 5.0, 3)


@query(f"WITH {SPRITES} SELECT 4 * i + k AS vertex, x + (k % 2 - 0.5::DOUBLE) * 5 AS x, y + (k // 2 - 0.5::DOUBLE) * 5 AS y, z FROM kept, range(4) t(k)")
def sprite_vertices(spark, d):
    return sprites(spark, d)[0]


@query(f"WITH {SPRITES} SELECT 4 * i AS a, 4 * i + CASE k WHEN 0 THEN 1 ELSE 3 END AS b, 4 * i + CASE k WHEN 0 THEN 3 ELSE 2 END AS c FROM kept, range(2) t(k)")
def sprite_faces(spark, d):
    return sprites(spark, d)[1]


EIGHT = SEG.replace("abs(a.r - b.r) + abs(a.c - b.c) = 1", "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1")


@query(f"{EIGHT}, n AS (SELECT label, count(*) AS size FROM seg GROUP BY label) SELECT id // 4096 AS r, id % 4096 AS c, label, size FROM seg JOIN n USING (label)")
def segments_of_eight(spark, d):
    """Height segments over eight neighbours, with their sizes, by tiles of four cells a side."""
    return segments.segments(surface_cells(spark, d), 10, 4096, segments.EIGHT, 4)
