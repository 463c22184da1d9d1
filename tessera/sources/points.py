"""Tables as point sources: point_id, the real coordinates x, y, z and the quantized qx, qy, qz."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.quantize import quantize


@dataclass(frozen=True)
class Quantization:
    """real = q * scale + offset, for each axis."""

    scale: tuple[float, float, float] = (0.01, 0.01, 0.01)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)


def points(df: DataFrame, point_id, x, y, z, quantization: Quantization) -> DataFrame:
    real = df.select(point_id.alias("point_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    axes = zip("xyz", quantization.scale, quantization.offset, strict=True)
    return real.select("*", *[quantize(F.col(a), s, o).alias(f"q{a}") for a, s, o in axes])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.unix_date(F.to_date("o_orderdate"))
    return points(df, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), day, Quantization((1.0, 0.01, 1.0)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return points(df, F.col("c_custkey"), F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey"), Quantization((1.0, 0.01, 1.0)))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No column tells all rows apart, so point_id is the order's key."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return points(df, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"), Quantization((1.0, 1.0, 0.01)))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Several sources as one; all must have the same columns."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out
