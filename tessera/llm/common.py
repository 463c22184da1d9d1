"""Helpers shared by the corpus operators: tables, the shared scratch folder, Arrow slices."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import release, scratch, written

__all__ = ["release", "scratch", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that holds more than one of so many rows is heavy; there are at most that many such keys.
HEAVY, SALTS = 200, 64


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined to facts, which has one row for each value of the keys and, as `weight`, how many rows have it.

    Heavy keys, at most HEAVY, are found from the weights; their rows are dealt to SALTS tasks and their facts
    are repeated so often, so no task gets all rows of one key. `weight` isn't in the result.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    mark = F.xxhash64(*keys)
    heavy = [r[0] for r in facts.where(F.col(weight) * HEAVY > max(total, HEAVY * SALTS)).select(mark).collect()]
    facts = facts.drop(weight)
    if not heavy:
        return rows.join(facts, keys)
    others = [F.col(c) for c in rows.columns if c not in keys]  # a salt from the row itself: the same if a task is run again
    dealt = F.when(mark.isin(heavy), F.pmod(F.xxhash64(*others), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(mark.isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = facts.withColumn("tessera_salt", F.explode(copies))
    return rows.withColumn("tessera_salt", dealt).join(salted, [*keys, "tessera_salt"]).drop("tessera_salt")


def forget(spark: SparkSession) -> None:
    """Let the driver find out which plans of earlier rounds are no longer referenced, so that Spark's
    cleaner removes their shuffle files; otherwise these stay until the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of bounded rows and bytes, so that what a Python
    worker holds beside one Arrow batch doesn't depend on the batch size of the session."""
    for batch in batches:
        step = max_rows
        if batch.num_rows and batch.nbytes > max_bytes:
            step = max(1, min(max_rows, int(max_bytes * batch.num_rows / batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def in_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], max_rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that applies fn to one slice after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_rows):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return run


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """k1, k2: 128 hashed bits that tell rows of different ids or texts apart; null ids are no different from others."""
    parts = F.col(id_col), F.col(text_col).cast("string")
    return F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")


def first_row(id_col: str) -> Column:
    """The first of a group's rows: that with the smallest id that isn't null; ties go by k1 and k2."""
    return F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "k1", "k2"))


def rows_with(df: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose row keys are among `keys` (k1, k2), one of those that are equal in id and text."""
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), *row_keys(id_col, text_col))
    return inner.join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("whole.*")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
