"""Quantized coordinates: real = q * scale + offset; quantizing truncates toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(real: Column, scale: float, offset: float) -> Column:
    return ((real - F.lit(offset)) / F.lit(scale)).cast("bigint")


def dequantize(q: Column, scale: float, offset: float) -> Column:
    return q * F.lit(scale) + F.lit(offset)


def automatic_scale(low: Column, high: Column) -> Column:
    """The power of ten that lets 31 bits hold the range: 10^-floor(log10(2^31 / range))."""
    return F.pow(F.lit(10.0), -F.floor(F.log10(F.lit(2.0**31) / F.greatest(high - low, F.lit(1e-9)))))


def automatic_offset(low: Column, high: Column) -> Column:
    """The whole number below the minimum, unless that leaves a gap larger than the range."""
    return F.when(low - F.floor(low) > high - low, low).otherwise(F.floor(low).cast("double"))
