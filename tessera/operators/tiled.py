"""Tiled storage: points clustered by tile in parquet, beside tables of the grid, the tiles and the statistics.

The points of a store are in folders by `lowres` (the low-resolution points of all tiles lie apart) and by band of tile
rows, and are sorted by tile inside files. So a read of some tiles opens the folders of their bands only, and
within their files the row groups whose tile columns can match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import grid
from tessera.operators.ordered import PART, PLACE, parts_in_order

#: Tile rows in a band.
BAND = 4
#: Low-resolution points of a store, at most.
LOWRES_BUDGET = 1_000_000


@dataclass(frozen=True)
class TiledPoints:
    """An opened store. `definition` has one row, `tiles` one for each tile that isn't empty, `statistics` one."""

    points: DataFrame
    definition: DataFrame
    tiles: DataFrame
    statistics: DataFrame

    def read(self, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
        """The points of tiles in a range of rows and of columns, ends included."""
        bands = F.col("band").between(rows[0] // BAND, rows[1] // BAND)
        return self.points.where(bands & F.col("tile_row").between(*rows) & F.col("tile_col").between(*columns))

    def lowres(self) -> DataFrame:
        return self.points.where("lowres")

    def main(self) -> DataFrame:
        return self.points.where("not lowres")

    def read_order(self) -> DataFrame:
        """The tiles as they lie in the store, by where their points begin."""
        return self.tiles.orderBy("point_offset", "valid_index")


def low_side(definition: DataFrame, counts: DataFrame, budget: int = LOWRES_BUDGET) -> int:
    """Sub-cells along a tile's side for a budget of low-resolution points, at most as many as a tile has cells."""
    tiles = counts.agg(F.count("*").alias("tiles")).crossJoin(definition.select(F.least("csx", "csy").alias("cell")))
    found = tiles.select(F.least(grid.lowres_side(F.col("tiles"), budget), F.col("cell"))).first()[0]
    return max(1, int(found or 1))


def write_tiled(points: DataFrame, cell: tuple[int, int], path: str, side: int | None = None) -> None:
    """Store points (point_id, x, y, z, qx, qy, qz) in tiles of a cell size. `side` sub-cells along a tile have a low-resolution
    point each; by default as many as LOWRES_BUDGET allows. An empty table makes a store without points."""
    definition = grid.grid(points, *cell)
    order = ["tile_row", "tile_col", "point_id", "qx", "qy", "qz"]
    # Ids may repeat: a row's part and place tell it apart, and split a tile of very many points over tasks.
    cells = parts_in_order(grid.celled(points, definition), order)
    low = grid.lowres(cells, side or low_side(definition, grid.density(cells)), ("point_id", PART, PLACE)).select(PART, PLACE, F.lit(True).alias("lowres"))
    marked = cells.join(low, [PART, PLACE], "left").withColumns({"lowres": F.coalesce("lowres", F.lit(False)), "band": F.floor(F.col("tile_row") / BAND).cast("int")})
    stored = marked.select("point_id", "x", "y", "z", "qx", "qy", "qz", "tile_row", "tile_col", "lowres", "band", PART, PLACE)
    keys = ["lowres", *order, PART, PLACE]
    stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(PART, PLACE).write.partitionBy("lowres", "band").parquet(f"{path}/points")
    definition.write.parquet(f"{path}/definition")
    # Counts are those of the rows that were stored.
    kept = spark_points(points.sparkSession, path)
    low_counts = kept.where("lowres").groupBy("tile_row", "tile_col").agg(F.count("*").alias("lowres_count"))
    grid.tile_table(grid.density(kept), low_counts).write.parquet(f"{path}/tiles")
    grid.histogram_statistics(grid.z_histogram(kept), kept).write.parquet(f"{path}/statistics")


SCHEMA = "point_id long, x double, y double, z double, qx long, qy long, qz long, tile_row long, tile_col long, lowres boolean, band int"


def spark_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/points")


def open_tiled(spark: SparkSession, path: str) -> TiledPoints:
    return TiledPoints(spark_points(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in ("definition", "tiles", "statistics")))


def write_rasters(cells: DataFrame, values: dict, path: str, side: int = 8) -> None:
    """Fixed-size raster tiles in long form: for each tile and pixel of side x side the aggregated values, in folders by band."""
    at = lambda q, low, tile, cs: F.least(F.expr(f"({q} - {low} - {tile} * {cs}) * {side} div {cs}"), F.lit(side - 1))
    pixels = cells.groupBy("tile_row", "tile_col", at("qy", "mny", "tile_row", "csy").alias("py"), at("qx", "mnx", "tile_col", "csx").alias("px")).agg(*[v.alias(n) for n, v in values.items()])
    pixels.withColumn("band", F.floor(F.col("tile_row") / BAND).cast("int")).repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "py", "px").write.partitionBy("band").parquet(path)
