"""Scales of quantized coordinates: the base of a scale, the scale that the data themselves need, and the way from one to another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import PART, PLACE, parts_in_order


def scale_base(inverse: int) -> int:
    """The number of which an inverse scale is a power: 10 for 1000, 2 for 256, 6 for 36."""
    factors, value, rest = {}, 2, inverse
    while rest > 1:
        while rest % value == 0:
            factors[value] = factors.get(value, 0) + 1
            rest //= value
        value += 1
    fewest = min(factors.values(), default=1)
    return math.prod(f * (n // fewest) for f, n in factors.items())


def neighbour_differences(values: DataFrame, column: str) -> DataFrame:
    """(difference, n): how often values that follow each other in order differ by so much, for differences above 0.

    Values lie in ranges; in each the differences are taken between rows, and across a border from the last value of the earlier range, of which there is
    a row a range. No window runs over all values."""
    parts = parts_in_order(values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")), ["value"])
    inside = Window.partitionBy(PART).orderBy(PLACE)
    ends = parts.groupBy(PART).agg(F.max("value").alias("last"))
    before = ends.select(PART, F.lag("last").over(Window.orderBy(PART)).alias("before"))  # a row for each partition
    stepped = parts.withColumn("ahead", F.lag("value").over(inside)).join(F.broadcast(before), PART)
    difference = F.col("value") - F.coalesce("ahead", "before")
    return stepped.select(difference.alias("difference")).where("difference > 0").groupBy("difference").agg(F.count("*").alias("n"))


def typical_scale(differences: DataFrame, scale: float) -> DataFrame:
    """One row, scale: as coarse as the mean logarithm of the differences allows, in powers of the scale's base; the given
    one where that is no coarser."""
    inverse = math.ceil(1 / scale)
    base = scale_base(inverse)
    power = round(math.log(inverse, base), 4) if base > 1 else 0.0
    power = int(power)
    mean = F.round(F.sum(F.log(F.col("difference").cast("double")) / math.log(max(base, 2)) * F.col("n")) / F.sum("n"), 3)
    found = differences.agg(F.floor(mean).cast("int").alias("k"))
    return found.select(F.when((F.col("k") > 0) & (F.col("k") < power), F.pow(F.lit(float(base)), F.col("k") - power)).otherwise(F.lit(scale)).alias("scale"))


def common_scale(differences: DataFrame, scale: float) -> DataFrame:
    """One row, scale: the coarsest power of the scale's base that divides every difference, so that no value changes."""
    inverse = math.ceil(1 / scale)
    base = scale_base(inverse)
    power = int(round(math.log(inverse, base), 4)) if base > 1 else 0
    divides = [F.when(F.max((F.col("difference") % base**k != 0).cast("int")) == 0, F.lit(k)).otherwise(F.lit(0)) for k in range(1, power + 1)]
    k = F.coalesce(F.greatest(F.lit(0), *divides) if divides else F.lit(0), F.lit(0))
    return differences.agg(k.alias("k")).select(F.pow(F.lit(float(base)), F.col("k") - power).alias("scale") if power else F.lit(scale).alias("scale"))


def requantized(q: Column, scale: float, offset: float, new_scale: float, new_offset: float) -> Column:
    """A quantized value in another scale and offset, truncated toward zero."""
    return (q * F.lit(scale / new_scale) + F.lit((offset - new_offset) / new_scale)).cast("bigint")
