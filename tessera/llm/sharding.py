"""Operator 8: shards along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a grid, each by its own quantiles, so values keep their order and every level
holds about as many rows; a Hilbert curve numbers the cells so that neighbours on the curve are neighbours in
the grid; the rows, ordered along the curve, are cut into runs. Each shard then covers a small box of the
metadata, so a filter on any of the columns prunes shards by their minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered, running_sums

#: Bits of each quantised dimension.
CURVE_BITS = 5


def hilbert_index(coordinates: list[Column], bits: int = CURVE_BITS) -> Column:
    """The position of a cell on the Hilbert curve (long), after Skilling's transposition.

    Coordinates are integers from 0 to 2^bits - 1; bits times dimensions must be below 63.
    """
    n = len(coordinates)
    cell = F.array(*[c.cast("long") for c in coordinates])
    # Undo excess work from the high bit down: one step for each (mask, dimension).
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("mask"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        mask, i = step["mask"], step["i"]
        low = mask - 1
        swap = F.when(x[i].bitwiseAND(mask) != 0, F.lit(0)).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(low))
        flip = F.when(x[i].bitwiseAND(mask) != 0, low).otherwise(swap)
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, flip).when(k == i, swap).otherwise(F.lit(0))))

    x = F.aggregate(steps, cell, undo)
    # Gray code: each coordinate takes in all those before it, then a correction from the last one.
    gray = F.transform(x, lambda v, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def finish(g: Column) -> Column:
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
        fix = F.aggregate(masks, F.lit(0).cast("long"), lambda t, m: t.bitwiseXOR(F.when(g[n - 1].bitwiseAND(m) != 0, m - 1).otherwise(F.lit(0))))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out * 2 + F.shiftright(g[i].bitwiseXOR(fix), b).bitwiseAND(F.lit(1).cast("long"))
        return out

    return F.transform(F.array(gray), finish)[0]


def borders(df: DataFrame, column: str, levels: int) -> list[tuple]:
    """(value, level), fewer than `levels`: the values at which levels above 0 begin, exact quantiles of the rows that
    aren't null.

    A value lies in one level only; one that many rows have takes up several, of which it uses the first. Counts
    go by distinct value, running sums by ranges of values; a border a level reaches the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = running_sums(counts, ["value"], {"before": F.col("n")})
    total = placed.agg(F.sum("n")).first()[0] or 0
    level = F.expr(f"before * {levels} div {max(total, 1)}")
    found = placed.groupBy(level.alias("level")).agg(F.min("value").alias("value")).where("level > 0")
    return sorted((r.value, r.level) for r in found.collect())


def quantised(column: Column, begins: list[tuple]) -> Column:
    """The level of a value: that of the last border it has reached; null is level 0, as the smallest values are."""
    level, before = F.lit(0), 0
    for value, here in begins:
        level, before = level + F.when(column >= F.lit(value), F.lit(here - before)).otherwise(F.lit(0)), here
    return level


def hilbert_shards(df: DataFrame, dimensions: list[str], ties: list[str], shards: int) -> DataFrame:
    """df with `curve`, `shard` (from 0) and `slot` (the row's number in its shard, from 0).

    `dimensions` are columns of any type with an order; `ties` orders rows of one cell. The counts of
    any two shards differ by one at most. Nulls lie in level 0 and first among ties; rows that are equal in
    all `ties` are ordered arbitrarily. An empty table gives none. Columns of df with the names of added ones are replaced.
    """
    levels = 1 << CURVE_BITS
    curve = hilbert_index([quantised(F.col(f"`{c}`"), borders(df, c, levels)) for c in dimensions])
    kept = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = numbered(df.select(whole.alias("whole"), curve.alias("curve"), *[F.col(f"`{c}`").alias(f"tie{i}") for i, c in enumerate(ties)]), ["curve", *[f"tie{i}" for i in range(len(ties))]])
    shard = F.expr(f"cast(position * {shards} div total as int)")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    placed = rows.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return placed.select(*[F.col(f"whole.`{c}`") for c in kept], "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, its rows in the order of the curve."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of the columns in each shard: what a reader prunes with."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
