"""A quadtree as an index of a file: nodes within a budget, and for each leaf the chunks that hold its points.

Nodes are rows (depth, path, n) as `surface.quadtree` makes them. Sets of chunks are bitmaps of fixed size, one for each leaf and range of
chunks, which unite by a bitwise or, so sets of inner nodes come from those of their leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import running_sums

#: The nodes of a tree at most, and the share by which it shrinks when it has more.
MOST_NODES, REDUCTION = 1365, 0.2


def parent(path: Column) -> Column:
    """The path of a node's parent."""
    return F.substring(path, F.lit(1), F.length(path) - 1)


def with_paths(points: DataFrame, levels: int) -> DataFrame:
    """points with `path`, the node of the last level that each lies in, and the root's corner and side (rx, ry, dim): a digit a level,
    twice the bit of y and that of x."""
    root = points.agg(F.min("x").alias("rx"), F.min("y").alias("ry"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("dim"))
    side = 1 << levels
    code = lambda v, low: F.least(F.floor((F.col(v) - F.col(low)) / F.col("dim") * side), F.lit(side - 1)).cast("bigint")
    bit = lambda c, i: F.shiftright(c, levels - 1 - i).bitwiseAND(F.lit(1).cast("bigint"))
    x, y = F.coalesce(code("x", "rx"), F.lit(0)), F.coalesce(code("y", "ry"), F.lit(0))  # points at one place have a root without size
    return points.crossJoin(F.broadcast(root)).withColumn("path", F.concat(*[(2 * bit(y, i) + bit(x, i)).cast("string") for i in range(levels)]))


def reduced(nodes: DataFrame, most: int = MOST_NODES, share: float = REDUCTION) -> DataFrame:
    """nodes with `final`, without those below a final one. If there are more than `most`, inner nodes are made final, deepest first and of a
    level those of fewest points first (ties by path), until at most `most` less the share of it are left."""
    target = most - int(share * most)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), parent(F.col("path")).alias("path")).agg(F.count("*").alias("kids"))
    inner = nodes.select("depth", "path", "n").join(kids, ["depth", "path"]).withColumn("upward", -F.col("depth"))
    placed = running_sums(inner, ["upward", "n", "path"], {"gone": F.col("kids")})
    total = nodes.agg(F.count("*").alias("total"))
    ended = placed.crossJoin(F.broadcast(total)).where((F.col("total") > most) & (F.col("total") - F.col("gone") > target)).select("depth", "path")
    below = ended.select((F.col("depth") + 1).alias("depth"), F.col("path").alias("parent"))
    kept = nodes.withColumn("parent", F.when(F.col("depth") > 0, parent(F.col("path")))).join(below, ["depth", "parent"], "left_anti").drop("parent")
    return kept.join(ended.withColumn("ended", F.lit(True)), ["depth", "path"], "left").withColumn("final", F.coalesce("ended", F.lit(False))).drop("ended")


def leaves(nodes: DataFrame, least: int) -> DataFrame:
    """The leaves below the root (depth, path, n): nodes without nodes below them, or with fewer than `least` points, under a node
    that has as many."""
    up = parent(F.col("path"))
    full = nodes.where((F.col("n") >= least) | (F.col("depth") == 0)).select((F.col("depth") + 1).alias("depth"), F.col("path").alias("up"))
    inner = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), up.alias("path")).distinct()
    some = nodes.where("depth > 0").join(inner.withColumn("inner", F.lit(True)), ["depth", "path"], "left")
    ends = some.where(F.col("inner").isNull() | (F.col("n") < least)).select("depth", "path", "n", up.alias("up"))
    return ends.join(full, ["depth", "up"], "left_semi").select("depth", "path", "n")


def chunk_bitmaps(placed: DataFrame, chunk: Column, leaf_nodes: DataFrame, levels: int) -> DataFrame:
    """(path, bucket, bits): for each leaf and range of chunks, which chunks hold a point of it. placed: points with `path`.

    Cells of the last level and chunks are made distinct first, so points of a chunk cost one row a cell."""
    pairs = placed.select(F.col("path").alias("cell"), F.explode(F.array_distinct(chunk)).alias("chunk")).distinct()
    owners = pairs.select("cell").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("path", F.substring(F.col("cell"), F.lit(1), F.col("depth")))
    owners = owners.join(leaf_nodes.select("path"), "path", "left_semi").select("cell", "path")
    place = F.col("chunk") + 1
    return pairs.join(owners, "cell").groupBy("path", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def united(bitmaps: DataFrame, path: Column) -> DataFrame:
    """The bitmaps of all leaves with the same value of `path` (such as a prefix of theirs) as one set each."""
    return bitmaps.groupBy(path.alias("path"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_sizes(bitmaps: DataFrame) -> DataFrame:
    """(path, chunks): how many chunks each set has."""
    return bitmaps.groupBy("path").agg(F.sum(F.bitmap_count("bits")).alias("chunks"))


def point_chunks(offset: Column, length: int, size: int) -> Column:
    """The chunks that a record's first and last byte lie in, as an array."""
    return F.array(F.floor(offset / size).cast("bigint"), F.floor((offset + length - 1) / size).cast("bigint"))


def map_size(points: DataFrame, most: int = 64) -> DataFrame:
    """One row: width and height of a map of points by their extent's aspect, the longer side `most`."""
    ratio = F.col("w") / F.col("h")
    ranges = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    width, height = F.when(ratio < 1, F.floor(most * ratio)).otherwise(F.lit(most)), F.when(ratio > 1, F.floor(most / ratio)).otherwise(F.lit(most))
    return ranges.select(F.greatest(width.cast("int"), F.lit(1)).alias("width"), F.greatest(height.cast("int"), F.lit(1)).alias("height"))


def footprint_map(leaf_nodes: DataFrame, value: Column, size: DataFrame, levels: int) -> DataFrame:
    """(r, c, value): the largest value of the leaves whose footprints cover a pixel of a map of the root's square.

    A footprint goes from the pixel its low side lies in up to, not including, that of its high side or the last one; leaves that
    are smaller than a pixel may cover none. A leaf makes the rows of its own pixels, so all make about as many as the map has.
    """
    digit = lambda i: F.substring("path", i + 1, 1).cast("int")
    bits = {"x": lambda i: digit(i) % 2, "y": lambda i: F.floor(digit(i) / 2).cast("int")}
    corner = lambda v: reduce(Column.__add__, [F.when(F.col("depth") > i, bits[v](i) * (1 << (levels - 1 - i))).otherwise(F.lit(0)) for i in range(levels)])
    span = F.call_function("shiftright", F.lit(1 << levels), F.col("depth").cast("int"))
    placed = leaf_nodes.select(corner("x").alias("x"), corner("y").alias("y"), span.alias("span"), value.alias("value")).crossJoin(F.broadcast(size))

    def pixels(v: str, side: str) -> Column:
        at = lambda place: F.least(F.floor(place * F.col(side) / (1 << levels)), F.col(side) - 1).cast("int")
        low, high = at(F.col(v)), at(F.col(v) + F.col("span"))
        return F.explode(F.when(high > low, F.sequence(low, high - 1)))

    spread = placed.withColumn("r", pixels("y", "height")).withColumn("c", pixels("x", "width"))
    return spread.groupBy("r", "c").agg(F.max("value").alias("value"))
