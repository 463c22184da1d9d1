"""Numbers and running sums over a whole table in an order, without a window that one task would have to hold.

A range partitioning deals rows to partitions in the order; what lies before a partition is the sum over
the earlier ones, a row for each partition. Partitions are written before they are numbered: a repeated task could
draw their borders otherwise. So a call runs jobs when it is made, not only when its result is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Names of columns that are only used inside; they hold what no column of a caller is called.
MARK, PART, PLACE, FIRST, VALUE = (f"tessera_{n}" for n in ("mark", "part", "place", "first", "value"))


def parts_in_order(df: DataFrame, order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """df's rows, or their columns `keep`, written, with PART and PLACE, their number in it: one shuffle, rows sorted
    inside partitions."""
    mark = F.monotonically_increasing_id()  # the partition, and below 33 bits the number of the row in it
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(MARK, mark)
    placed = placed.select(*keep, MARK) if keep is not None else placed
    return written(placed, "ranged").withColumns({PART: F.shiftright(MARK, 33), PLACE: F.col(MARK).bitwiseAND(F.lit((1 << 33) - 1))}).drop(MARK)


def numbered(df: DataFrame, order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """df (its columns `keep`, all by default) with `position`, the row's number from 0 in the order of the columns, and
    `total`, the number of rows. Columns of df with these names are replaced.

    Equal keys can't overload a partition as long as the last column of the order tells rows apart.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("position", "total")]
    parts = parts_in_order(df, order, kept)
    counts = parts.groupBy(PART).count()
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row for each partition: bounded by the number of partitions.
    firsts = counts.select(PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(FIRST), F.sum("count").over(everything).alias("total"))
    return parts.join(F.broadcast(firsts), PART).select(*[F.col(f"`{c}`") for c in kept], "total", (F.col(FIRST) + F.col(PLACE)).alias("position"))


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with `position`, the row's number from 0, and for each name the sum of a column of longs over all rows before it.
    Columns of df with these names are replaced."""
    kept = [c for c in df.columns if c != "position" and c not in sums]
    values = {f"{VALUE}_{i}": c.cast("long") for i, c in enumerate(sums.values())}
    parts = parts_in_order(df.withColumns(values), order, [*kept, *values])
    totals = parts.groupBy(PART).agg(F.count("*").alias(VALUE), *[F.sum(v).alias(v) for v in values])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(PART, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{FIRST}_{v}") for v in (VALUE, *values)])
    inside = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    placed = {n: F.col(f"{FIRST}_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in zip(sums, values, strict=True)}
    rows = parts.join(F.broadcast(firsts), PART)
    return rows.select(*[F.col(f"`{c}`") for c in kept], (F.col(f"{FIRST}_{VALUE}") + F.col(PLACE)).alias("position"), *[c.alias(n) for n, c in placed.items()])
