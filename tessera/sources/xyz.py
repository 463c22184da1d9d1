"""Text files with a point a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.las import filesystem, opened

NUMBER = r"[0-9]+(?:\.[0-9]*)?"


def parsed_lines(lines: DataFrame, signed: bool = True) -> DataFrame:
    """(x, y, z, bad): the first three decimal numbers anywhere in each line of the column `value`. Lines with
    fewer are bad and have null coordinates. Unsigned parsing takes minus signs for separators."""
    numbers = F.regexp_extract_all("value", F.lit(f"(-?{NUMBER})" if signed else f"({NUMBER})"))
    found = lines.select(numbers.alias("v"))
    bad = F.coalesce(F.size("v") < 3, F.lit(True))
    return found.select(*[F.when(~bad, F.get("v", F.lit(i)).cast("double")).alias(a) for i, a in enumerate("xyz")], bad.alias("bad"))


def read_xyz(spark: SparkSession, path: str, signed: bool = True) -> DataFrame:
    """The points of text files; bad lines are left out."""
    return parsed_lines(spark.read.text(path), signed).where(~F.col("bad")).drop("bad")


def write_xyz(points: DataFrame, path: str, digits: int = 2) -> None:
    line = F.concat_ws(" ", *[F.col(a).cast(f"decimal(38,{digits})").cast("string") for a in "xyz"])
    points.select(line.alias("value")).write.text(path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: the extent of the points of text files, how many there are, and how many lines were skipped."""
    lines = parsed_lines(spark.read.text(path))
    bounds = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return lines.agg(*bounds, F.count_if(~F.col("bad")).alias("n_points"), F.count_if("bad").alias("skipped"))


#: Three numbers at the beginning of a line, each with a point, between single spaces; what follows is ignored.
STRICT = r"^(-?[0-9]*\.[0-9]*) (-?[0-9]*\.[0-9]*) (-?[0-9]*\.[0-9]*)(?: |\r|$)"


def read_strict(spark: SparkSession, path: str, most_bad: int = 1000) -> DataFrame:
    """The points of lines that begin with three numbers, of which each must have a point; others are skipped, more than `most_bad` of
    them are an error."""
    lines = spark.read.text(path)
    rows = lines.select(*[F.regexp_extract("value", STRICT, i).try_cast("double").alias(a) for i, a in enumerate("xyz", 1)])
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    check = rows.agg(F.assert_true(F.count_if(bad) <= most_bad, F.lit("too many lines can't be parsed")).alias("fine"))
    # The check gives null, or the error; a filter on it keeps it from being pruned.
    return rows.where(~bad).crossJoin(F.broadcast(check)).where("fine is null").drop("fine")


def write_binary(points: DataFrame, folder: str) -> DataFrame:
    """Writes x, y and z as files of three doubles a point, when the result, (file, n_points), is evaluated; best once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"part-{task.partitionId():06d}.xyzb", 0
        with fs.open_output_stream(f"{root}/{name}.{task.taskAttemptId()}", compression=None) as f:
            for batch in batches:
                rows = np.stack([c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                f.write(rows.astype("<f8").tobytes())
                n += len(rows)
        fs.move(f"{root}/{name}.{task.taskAttemptId()}", f"{root}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([n])], ["file", "n_points"])

    return points.select(*[F.col(a).cast("double").alias(a) for a in "xyz"]).mapInArrow(run, "file string, n_points long")


def read_binary(spark: SparkSession, folder: str, size: int = 1 << 18) -> DataFrame:
    """The points of such files, in ranges of `size` that Spark deals out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    f.seek(24 * r["start"])
                    rows = np.frombuffer(f.read(24 * size), "<f8").reshape(-1, 3)
                yield pa.record_batch([pa.array(rows[:, i]) for i in range(3)], ["x", "y", "z"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xyzb").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.expr("length div 24").alias("n")).where("n > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInArrow(run, "x double, y double, z double")
