"""Rasters, meshes, slopes, segments, and the quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators.ordered import numbered


def quadtree(points: DataFrame, levels: int) -> DataFrame:
    """(depth, path, n): the count of every node down to `levels`. Points are counted by leaf first, so the
    rollup over path prefixes expands cells, not points."""
    root = points.agg(F.min("x").alias("rx"), F.min("y").alias("ry"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("dim"))
    side = 1 << levels
    code = lambda v, low: F.least(F.floor((F.col(v) - F.col(low)) / F.col("dim") * side), F.lit(side - 1)).cast("bigint")
    leaves = points.crossJoin(F.broadcast(root)).select(code("x", "rx").alias("cx"), code("y", "ry").alias("cy")).groupBy("cx", "cy").count()
    digits = [F.concat(*[(F.shiftright("cy", levels - 1 - i).bitwiseAND(F.lit(1).cast("bigint")) * 2 + F.shiftright("cx", levels - 1 - i).bitwiseAND(F.lit(1).cast("bigint"))).cast("string") for i in range(d)]) if d else F.lit("") for d in range(levels + 1)]
    nodes = leaves.select("count", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), p.alias("path")) for d, p in enumerate(digits)])).alias("node"))
    return nodes.groupBy("node.depth", "node.path").agg(F.sum("count").alias("n"))


def quadtree_leaves(nodes: DataFrame, levels: int, least: int) -> DataFrame:
    """Nodes that aren't divided further: below `least` points or on the last level, under a parent that is divided."""
    parents = nodes.where(F.col("n") >= least).select(F.col("path").alias("parent"), (F.col("depth") + 1).alias("depth"))
    inner = nodes.where((F.col("depth") > 0) & ((F.col("n") < least) | (F.col("depth") == levels)))
    return inner.withColumn("parent", F.expr("substring(path, 1, depth - 1)")).join(parents, ["depth", "parent"], "left_semi").select("depth", "path", "n")


def raster(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tile_row", "tile_col").agg(F.max("qz").alias("qz"))


def shifted(cells: DataFrame, rows: int, columns: int, name: str) -> DataFrame:
    """The cells that lie `rows` and `columns` before those they are joined to."""
    return cells.select((F.col("r") + rows).alias("r"), (F.col("c") + columns).alias("c"), F.col("v").alias(name))


def triangles(cells: DataFrame) -> DataFrame:
    """Up to two triangles between each cell and its left, upper and upper-left neighbours, from the corners
    that exist. cells: r, c, v. Returns the corners' (row, column) pairs as longs row * 2^20 + column."""
    at = lambda r, c: F.col("r") * (1 << 20) - r * (1 << 20) + F.col("c") - c
    joined = cells
    for name, r, c in (("left", 0, 1), ("up", 1, 0), ("corner", 1, 1)):
        joined = joined.join(shifted(cells, r, c, name), ["r", "c"], "left")
    one = F.when(F.col("left").isNotNull() & F.col("up").isNotNull(), F.struct(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c3")))
    two = F.when(F.col("left").isNotNull() & F.col("up").isNotNull() & F.col("corner").isNotNull(), F.struct(at(1, 1).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c3")))
    found = joined.select(F.explode(F.array(one, two)).alias("t")).where("t is not null")
    return found.select("t.a", "t.b", F.col("t.c3").alias("c"))


def cell_normals(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """(r, c, v, nz1, nz2): the upward components of the unit normals of a cell's two triangles through its upper-left
    corner, (corner, up, cell) and (corner, left, cell), for cells at real distances."""
    joined = cells
    for name, r, c in (("left", 0, 1), ("up", 1, 0), ("corner", 1, 1)):
        joined = joined.join(shifted(cells, r, c, name), ["r", "c"])

    def upward(along_x: Column, along_y: Column) -> Column:
        return F.lit(dx * dy) / F.sqrt(F.lit((dx * dy) ** 2) + F.pow(F.lit(dy) * along_x, F.lit(2)) + F.pow(F.lit(dx) * along_y, F.lit(2)))

    one = upward(F.col("up") - F.col("corner"), F.col("v") - F.col("up"))
    two = upward(F.col("v") - F.col("left"), F.col("left") - F.col("corner"))
    return joined.select("r", "c", "v", one.alias("nz1"), two.alias("nz2"))


def slopes(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """The larger of the two upward components at each cell: 1 where it is flat."""
    return cell_normals(cells, dx, dy).select("r", "c", F.round(F.greatest("nz1", "nz2"), 9).alias("nz"))


def vertices(cells: DataFrame, dx: float, dy: float, mode: float = 0.0) -> DataFrame:
    """(vertex, x, y, z): the mesh's vertices about the middle of the raster's extent; a cell lies where it begins. Heights are above the
    lowest one, less that of the centre of mass, `mode`."""
    facts = cells.agg(F.min("c").alias("c0"), (F.max("c") - F.min("c") + 1).alias("nc"), F.min("r").alias("r0"), (F.max("r") - F.min("r") + 1).alias("nr"), F.min("v").alias("v0"))
    at = lambda name, low, n, size: (F.col(name) - F.col(low)) / F.col(n) * (F.col(n) * F.lit(size)) - F.col(n) * F.lit(size) / 2
    rows = cells.crossJoin(F.broadcast(facts))
    return rows.select((F.col("r") * (1 << 20) + F.col("c")).alias("vertex"), at("c", "c0", "nc", dx).alias("x"), at("r", "r0", "nr", dy).alias("y"), (F.col("v") - F.col("v0") - F.lit(mode)).alias("z"))


def with_back_faces(faces: DataFrame) -> DataFrame:
    """Each triangle (a, b, c), and behind it the one that turns the other way."""
    return faces.union(faces.select("a", F.col("c").alias("b"), F.col("b").alias("c")))


def vertex_normals(faces: DataFrame, corners: DataFrame) -> DataFrame:
    """(vertex, nx, ny, nz): the sum of the cross products of a vertex's faces, of length 1 and upward."""
    joined = faces
    for name in ("a", "b", "c"):
        joined = joined.join(corners.select(F.col("vertex").alias(name), F.struct("x", "y", "z").alias(f"p{name}")), name)
    at = lambda p: tuple(F.col(f"{p}.{axis}") for axis in "xyz")
    normal = geometry.cross(geometry.minus(at("pb"), at("pa")), geometry.minus(at("pc"), at("pa")))
    flipped = [F.when(normal[2] < 0, -v).otherwise(v) for v in normal]
    spread = joined.select(F.explode(F.array("a", "b", "c")).alias("vertex"), *[v.alias(n) for n, v in zip(("x", "y", "z"), flipped, strict=True)])
    sums = spread.groupBy("vertex").agg(*[F.sum(a).alias(a) for a in "xyz"])
    return sums.select("vertex", *[v.alias(n) for n, v in zip(("nx", "ny", "nz"), geometry.unit((F.col("x"), F.col("y"), F.col("z"))), strict=True)])


def neighbour_sums(cells: DataFrame, radius: int) -> DataFrame:
    """The sum of v over the square of cells around each cell: offsets are exploded, then an equi-join."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = cells.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "v")
    sums = spread.groupBy("r", "c").agg(F.sum("v").alias("around"))
    return cells.select("r", "c").join(sums, ["r", "c"])


def leaf_report(leaves: DataFrame, points: DataFrame) -> DataFrame:
    """Points to a unit of area: naive, of all points over their extent; over the leaves the mean, the least, the most, and as median the
    element at half their number in the order of densities."""
    facts = points.agg(F.count("*").alias("all"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).withColumn("side", F.greatest("w", "h"))
    density = F.col("n") * F.pow(F.pow(F.lit(2.0), "depth") / F.col("side"), F.lit(2))
    placed = numbered(leaves.crossJoin(F.broadcast(facts)).select(density.alias("density"), "path"), ["density", "path"])
    median = F.max(F.when(F.col("position") == F.expr("total div 2"), F.col("density")))
    found = placed.agg(median.alias("median"), F.avg("density").alias("mean"), F.min("density").alias("least"), F.max("density").alias("most"))
    return facts.select((F.col("all") / (F.col("w") * F.col("h"))).alias("naive")).crossJoin(found)


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule by ray casting."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 != y1:
            spans = (F.lit(y0) > y) != (F.lit(y1) > y)
            crossings = crossings + F.when(spans & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return crossings % 2 == 1


def along_segment(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float]) -> tuple[Column, Column]:
    """The position along a segment (0 to 1, clamped) and the squared distance from it."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    t = F.least(F.greatest(((x - start[0]) * dx + (y - start[1]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    px, py = x - (start[0] + t * dx), y - (start[1] + t * dy)
    return t, px * px + py * py


def point_sprites(points: DataFrame, number: str, size: float, thin: int = 1) -> tuple[DataFrame, DataFrame]:
    """Squares for points (x, y, z and a column that numbers them from 0), every thin-th one: vertices (vertex, x, y, z), four for each point,
    and the triangles (a, b, c) between them. A point's vertices are four times its number and the three that follow."""
    kept = points.where(F.col(number) % thin == 0)
    ends = [(F.lit(2 * j + i), F.col("x") + (i - 0.5) * size, F.col("y") + (j - 0.5) * size) for j in (0, 1) for i in (0, 1)]
    corner = F.explode(F.array(*[F.struct(k.alias("k"), x.alias("x"), y.alias("y")) for k, x, y in ends])).alias("p")
    vertices_ = kept.select(F.col(number).alias("i"), corner, "z").select((4 * F.col("i") + F.col("p.k")).alias("vertex"), "p.x", "p.y", "z")
    at = lambda k: 4 * F.col(number) + k
    pair = F.explode(F.array(*[F.struct(at(a).alias("a"), at(b).alias("b"), at(c).alias("c")) for a, b, c in ((0, 1, 3), (0, 3, 2))])).alias("t")
    return vertices_, kept.select(pair).select("t.*")
