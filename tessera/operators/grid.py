"""Extents, grids, cells, density, tiles and their index, as DataFrame transformations.

Parameters that come from the data (extent, grid) are one-row DataFrames that are cross-joined. Orders over all tiles or
chunks go by ranges (see `ordered`), which are written when a query is built; no window over rows lacks a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered, running_sums


def extent(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def quotient(a: Column, b: Column | int) -> Column:
    """Integer division of numbers that aren't negative."""
    return F.floor(a / b).cast("bigint")


def grid(points: DataFrame, cell_x: int, cell_y: int) -> DataFrame:
    """One row: the quantized minimum, cell sizes and counts of columns and rows."""
    facts = points.agg(F.min("qx").alias("mnx"), F.max("qx").alias("mxx"), F.min("qy").alias("mny"), F.max("qy").alias("mxy"))
    count = lambda low, high, cell: F.greatest(F.lit(1), F.ceil((F.col(high) - F.col(low)) / cell)).cast("bigint")
    return facts.select("*", F.lit(cell_x).cast("bigint").alias("csx"), F.lit(cell_y).cast("bigint").alias("csy"), count("mnx", "mxx", cell_x).alias("n_cols"), count("mny", "mxy", cell_y).alias("n_rows"))


def celled(points: DataFrame, definition: DataFrame) -> DataFrame:
    """points with tile_row and tile_col; the maximum edge belongs to the last cell."""
    row = F.least(quotient(F.col("qy") - F.col("mny"), F.col("csy")), F.col("n_rows") - 1)
    column = F.least(quotient(F.col("qx") - F.col("mnx"), F.col("csx")), F.col("n_cols") - 1)
    return points.crossJoin(F.broadcast(definition)).withColumn("tile_row", row).withColumn("tile_col", column)


def density(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.min("qz").alias("min_qz"), F.max("qz").alias("max_qz"))


def density_summary(counts: DataFrame, cell_area: float | None = None) -> DataFrame:
    """Totals over non-empty tiles; the median is the element at n div 2 of the sorted counts, the mean is truncated. With the
    area of a cell also the densities. How many tiles have a count decides: running sums over different counts find the median."""
    alike = running_sums(counts.groupBy("n").agg(F.count("*").alias("tiles")), ["n"], {"before": F.col("tiles")})
    facts = alike.agg(F.sum(F.col("n") * F.col("tiles")).alias("points"), F.sum("tiles").alias("valid_tiles"), F.min("n").alias("min_count"), F.max("n").alias("max_count"))
    middle = F.expr("valid_tiles div 2")
    median = alike.crossJoin(F.broadcast(facts)).where((F.col("before") <= middle) & (middle < F.col("before") + F.col("tiles"))).select(F.col("n").alias("median_count"))
    out = facts.crossJoin(F.broadcast(median)).withColumn("mean_count", F.expr("points div valid_tiles"))
    if cell_area is not None:
        out = out.withColumns({f"{k}_density": F.col(f"{k}_count") / F.lit(cell_area) for k in ("min", "max", "median", "mean")})
    return out


def side_for_density(density: Column, desired: int) -> Column:
    """The side of square tiles that hold about `desired` points at a density."""
    return F.sqrt(F.lit(float(desired)) / density)


def lowres_side(tiles: Column, budget: int) -> Column:
    """Sub-cells along a tile's side so that low-resolution points of all tiles stay within a budget."""
    return F.floor(F.sqrt(F.lit(float(budget)) / F.greatest(tiles, F.lit(1)))).cast("int")


def detail_sides(valid_tiles: Column, median_count: Column) -> tuple[Column, Column]:
    """Raster sides of a tile for two levels of detail: far and near."""
    return F.floor(F.sqrt(F.lit(160_000.0) / valid_tiles)).cast("int"), F.floor(F.sqrt(median_count.cast("double")) / 3).cast("int")


def raster_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Columns and rows of a raster over an extent: the longer side has `most`, the other as many as the aspect asks for."""
    aspect = width / height
    wide = width >= height
    return F.when(wide, F.lit(most)).otherwise(F.ceil(F.lit(most) * aspect)).cast("int"), F.when(wide, F.ceil(F.lit(most) / aspect)).otherwise(F.lit(most)).cast("int")


def cells_for_size(low: Column, high: Column, size: float) -> Column:
    """How many cells of a real size cover a range."""
    return F.greatest(F.lit(1), F.ceil((high - low) / F.lit(size))).cast("bigint")


def estimation_side(area: Column, n: Column, desired: int) -> Column:
    tiles = F.least(F.greatest(F.lit(1), F.floor(n / desired)) * 16, F.lit(10_000_000))
    return F.sqrt(area / tiles)


def tile_table(counts: DataFrame, lowres: DataFrame) -> DataFrame:
    """A row for each non-empty tile in row-major order: its ordinal and the offsets of its points and of its
    low-resolution points, which lie apart."""
    tiles = counts.select("tile_row", "tile_col", F.col("n").alias("point_count")).join(lowres, ["tile_row", "tile_col"], "left").fillna(0, ["lowres_count"])
    apart = {"point_offset": F.col("point_count") - F.col("lowres_count"), "lowres_offset": F.col("lowres_count")}
    placed = running_sums(tiles, ["tile_row", "tile_col"], apart)
    return placed.select(
        "tile_row", "tile_col", packed_id(F.col("tile_row"), F.col("tile_col")).alias("tile_id"), F.col("position").alias("valid_index"),
        "point_offset", "point_count", "lowres_offset", "lowres_count",
    )


def packed_id(row: Column, column: Column) -> Column:
    return F.shiftleft(row, 16).bitwiseOR(column)


def unpacked_id(tile_id: Column) -> tuple[Column, Column]:
    """Row and column of a packed id."""
    return F.shiftright(tile_id, 16), tile_id.bitwiseAND(F.lit(0xFFFF))


def lowres(cells: DataFrame, side: int, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """The lowest point (then smallest by `keys`, which tell points apart) of each of side x side sub-cells of a tile; what lies beyond the last
    sub-cell is no candidate."""
    sub = lambda q, low, at, cs: quotient(F.col(q) - F.col(low) - F.col(at) * F.col(cs), F.greatest(F.lit(1).cast("bigint"), quotient(F.col(cs), side)))
    placed = cells.withColumn("sub_row", sub("qy", "mny", "tile_row", "csy")).withColumn("sub_col", sub("qx", "mnx", "tile_col", "csx"))
    best = F.min(F.struct("qz", *keys)).alias("best")
    found = placed.where((F.col("sub_row") < side) & (F.col("sub_col") < side)).groupBy("tile_row", "tile_col", "sub_row", "sub_col").agg(best)
    return found.select("tile_row", "tile_col", "sub_row", "sub_col", *[f"best.{k}" for k in keys], "best.qz")


def z_histogram(points: DataFrame, bits: int = 10) -> DataFrame:
    """(bin, n): bins of a power-of-two width by right shift; what exceeds the last bin joins it."""
    facts = points.agg(F.min("qz").alias("mn"), F.max("qz").alias("mx"))
    facts = facts.withColumn("s", F.greatest(F.when(F.col("mx") > F.col("mn") + 1, F.length(F.bin(F.col("mx") - F.col("mn") - 1))).otherwise(0) - bits, F.lit(0)))
    shifted = points.crossJoin(F.broadcast(facts))
    bin_ = F.expr("least(shiftright(qz, s) - shiftright(mn, s), shiftright(mx - mn, s))").cast("bigint")
    return shifted.select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def histogram_statistics(histogram: DataFrame, points: DataFrame) -> DataFrame:
    """Mean, sample variance and mode (centre of the first fullest bin) from the bins."""
    facts = points.agg(F.min("qz").alias("mn"), F.max("qz").alias("mx"))
    bins = facts.withColumn("s", F.greatest(F.when(F.col("mx") > F.col("mn") + 1, F.length(F.bin(F.col("mx") - F.col("mn") - 1))).otherwise(0) - 10, F.lit(0)))
    bins = bins.withColumn("k", F.expr("shiftright(mx - mn, s) + 1"))
    centre = (F.col("bin") + 0.5) / F.col("k") * (F.col("mx") - F.col("mn")) + F.col("mn")
    rows = histogram.crossJoin(F.broadcast(bins)).withColumn("c", centre)
    mean = rows.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("mean"), F.max_by("c", F.struct("n", -F.col("bin"))).alias("mode"))
    # In a second pass the squares of deviations: nothing cancels, however far the values are from zero.
    apart = F.col("c") - F.col("mean")
    found = rows.crossJoin(F.broadcast(mean)).agg(F.try_divide(F.sum(F.col("n") * apart * apart), F.first("total") - 1).alias("variance"), F.first("mean").alias("mean"), F.first("mode").alias("mode"))
    return found.select(F.round("mean", 3).alias("mean"), F.round("variance", 1).alias("variance"), F.round("mode", 3).alias("mode"))


def chunk_id(size: int) -> Column:
    """The chunk of consecutive points that a point belongs to."""
    return quotient(F.col("point_id"), size)


def runs(ids: DataFrame, column: str) -> DataFrame:
    """(start, length) of runs of consecutive ids."""
    island = F.col(column) - F.col("position")
    return numbered(ids.select(column), [column]).select(column, island.alias("island")).groupBy("island").agg(F.min(column).alias("start"), F.count("*").alias("length")).drop("island")


def within_budget(tiles: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The tiles (column n) that stay when the last ones in the order are dropped until their points fit a budget."""
    placed = running_sums(tiles, order, {"before": F.col("n")})
    return placed.where(F.col("before") + F.col("n") <= budget).drop("position", "before")


def in_segments(tiles: DataFrame, order: list[str], budget: int) -> DataFrame:
    """tiles (column n) with `segment`: in the order, those whose points begin within the same budget, and `buffer_position`,
    where a tile's points begin in its segment's buffer. No window runs over all tiles."""
    placed = running_sums(tiles, order, {"before": F.col("n")}).withColumn("segment", F.expr(f"before div {budget}"))
    first = F.min("before").over(Window.partitionBy("segment"))
    return placed.withColumn("buffer_position", F.col("before") - first).drop("position", "before")


def thinning_step(points: Column, most: int) -> Column:
    """The step that leaves at most so many points."""
    return F.greatest(F.lit(1.0), points / F.lit(float(most)))


def covering_cells(low: Column, high: Column, begin: Column, size: float) -> Column:
    """The numbers of fine cells of a size, from `begin` on, that a range from low to high overlaps, as an array."""
    first = F.floor((low - begin) / size)
    return F.sequence(first.cast("bigint"), F.greatest(first, F.ceil((high - begin) / size) - 1).cast("bigint"))


def around(points: DataFrame, radius: float) -> DataFrame:
    """(point_id, around): how many other points lie within a radius in the plane. Points meet in square buckets of that side:
    each goes to its own and the eight next to it as a candidate, so only near ones are compared."""
    bucket = lambda a: F.floor(F.col(a) / radius).cast("bigint")
    own = points.select("point_id", "x", "y", bucket("x").alias("bx"), bucket("y").alias("by"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    spread = own.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    others = spread.select((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), F.col("point_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = F.count_if((dx * dx + dy * dy <= radius * radius) & (F.col("other") != F.col("point_id")))
    return own.join(others, ["bx", "by"]).groupBy("point_id").agg(near.alias("around"))


def thinned(points: DataFrame, number: str, step: float) -> DataFrame:
    """Every step-th point by number (from 0), for a fractional step: the numbers trunc(k * step)."""
    n = F.col(number)
    return points.where(F.ceil(n / step) * F.lit(step) < n + 1)


def morton(row: Column, column: Column, bits: int = 16) -> Column:
    """Z-order: the bits of column and row interleaved, column lowest."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(column, b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(row, b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b + 1))
    return out
