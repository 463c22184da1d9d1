"""Meshes of tiles, each as fine as its raster, and the strips that close the gaps between them.

A tile's vertices are the pixels of its raster, side x side of them; sides may differ. Between two tiles that touch, the borders that
face each other are joined by a strip of triangles: both are walked at once, always the one that lags behind, so a
border of any resolution meets one of any other without an open edge. Where four tiles meet, two triangles close the corner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import packed_id

TILE = ["tile_row", "tile_col"]


def vertex_id(tile: Column, py: Column, px: Column) -> Column:
    """One number for a pixel of a tile; sides are below 1024."""
    return F.shiftleft(tile.cast("long"), 20).bitwiseOR(F.shiftleft(py.cast("long"), 10)).bitwiseOR(px.cast("long"))


def numbers(count: Column) -> Column:
    """0 to count - 1 as an array, which may be empty."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def tile_vertices(cells: DataFrame, sides: DataFrame) -> DataFrame:
    """(tile_row, tile_col, vertex, py, px, qz): a vertex for each pixel of each tile of `sides` (tile_row, tile_col, side, fill): the
    highest point there, or the tile's `fill`."""
    at = lambda q, low, tile, cs: F.least(F.expr(f"({q} - {low} - {tile} * {cs}) * side div {cs}"), F.col("side") - 1).cast("int")
    seen = cells.join(sides.select(*TILE, "side"), TILE).groupBy(*TILE, at("qy", "mny", "tile_row", "csy").alias("py"), at("qx", "mnx", "tile_col", "csx").alias("px")).agg(F.max("qz").alias("top"))
    every = sides.withColumn("py", F.explode(numbers(F.col("side")))).withColumn("px", F.explode(numbers(F.col("side"))))
    tile = packed_id(F.col("tile_row"), F.col("tile_col"))
    return every.join(seen, [*TILE, "py", "px"], "left").select(*TILE, vertex_id(tile, F.col("py"), F.col("px")).alias("vertex"), "py", "px", F.coalesce("top", "fill").alias("qz"))


def triangles_of(rows: DataFrame, kind: str, *corners: list[Column]) -> DataFrame:
    listed = F.array(*[F.struct(*[v.alias(n) for n, v in zip("abc", c, strict=True)]) for c in corners])
    return rows.select(F.lit(kind).alias("kind"), F.explode(listed).alias("t")).select("kind", "t.a", "t.b", "t.c")


def inner_faces(sides: DataFrame) -> DataFrame:
    """The two triangles of each square of four pixels of a tile."""
    at = sides.withColumn("y", F.explode(numbers(F.col("side") - 1))).withColumn("x", F.explode(numbers(F.col("side") - 1)))
    v = lambda y, x: vertex_id(packed_id(F.col("tile_row"), F.col("tile_col")), F.col("y") + y, F.col("x") + x)
    return triangles_of(at, "inner", [v(0, 0), v(0, 1), v(1, 0)], [v(1, 0), v(0, 1), v(1, 1)])


def beside(sides: DataFrame, rows: int, columns: int, name: str) -> DataFrame:
    """The side of the tile that lies so many rows and columns before, as a column; tiles without one are left out."""
    return sides.select((F.col("tile_row") + rows).alias("tile_row"), (F.col("tile_col") + columns).alias("tile_col"), F.col("side").alias(name))


def strip(sides: DataFrame, kind: str) -> DataFrame:
    """The triangles between each tile and the one at its left, or above it ("top").

    Positions along both borders go from 0 to 1. A step of the other's border from i to i + 1 makes a triangle with the own vertex that
    is reached by then, and the other way round; at equal positions the other's border goes first.
    """
    left = kind == "left"
    near = sides.join(beside(sides, 0 if left else 1, 1 if left else 0, "other"), TILE)
    own_tile = packed_id(F.col("tile_row"), F.col("tile_col"))
    other_tile = packed_id(F.col("tile_row") - (0 if left else 1), F.col("tile_col") - (1 if left else 0))
    own = lambda k: vertex_id(own_tile, k, F.lit(0)) if left else vertex_id(own_tile, F.lit(0), k)
    last = F.col("other") - 1
    other = lambda k: vertex_id(other_tile, k, last) if left else vertex_id(other_tile, last, k)
    i, j = F.col("i"), F.col("j")
    n, m = F.col("side") - 1, F.col("other") - 1
    theirs = near.withColumn("i", F.explode(numbers(m))).withColumn("j", F.greatest(F.ceil((i + 1) * n / m) - 1, F.lit(0)).cast("int"))
    ours = near.withColumn("j", F.explode(numbers(n))).withColumn("i", F.floor((j + 1) * m / n).cast("int"))
    return triangles_of(theirs, kind, [other(i), other(i + 1), own(j)]).union(triangles_of(ours, kind, [own(j), own(j + 1), other(i)]))


def corners(sides: DataFrame) -> DataFrame:
    """Two triangles where a tile meets those above, at the left and between them; the three must exist."""
    near = sides.join(beside(sides, 1, 1, "before"), TILE).join(beside(sides, 1, 0, "above"), TILE).join(beside(sides, 0, 1, "aside"), TILE)
    tile = lambda r, c: packed_id(F.col("tile_row") - r, F.col("tile_col") - c)
    last = lambda name: F.col(name) - 1
    before, above = vertex_id(tile(1, 1), last("before"), last("before")), vertex_id(tile(1, 0), last("above"), F.lit(0))
    aside, own = vertex_id(tile(0, 1), F.lit(0), last("aside")), vertex_id(tile(0, 0), F.lit(0), F.lit(0))
    return triangles_of(near, "corner", [before, above, aside], [aside, above, own])


def stitched(sides: DataFrame) -> DataFrame:
    """(kind, a, b, c): the triangles of all tiles (tile_row, tile_col, side) and between them. A tile that has no neighbour keeps its
    border open there; a tile of side 1 is a point with strips around it. Joins are on tiles, never on vertices."""
    return reduce(DataFrame.union, [inner_faces(sides), strip(sides, "left"), strip(sides, "top"), corners(sides)])
