"""Where files and tables of intermediate results go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir, which driver and executors share; Hadoop deletes it when
    the driver ends.

    Where the setting is missing, a temporary folder is taken, but only in local mode: there all tasks
    run on this machine. On a cluster a missing setting is an error.
    """
    known = spark.conf.get("tessera.scratch", None)
    if known:
        return known
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
    path = f"{top.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    spark.conf.set("tessera.scratch", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written once as a table in the shared folder (or in another one, which must be shared too) and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and a plan that
    uses the rows twice computes them once.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def apart(spark: SparkSession) -> Iterator[str]:
    """What is written meanwhile goes to a folder of its own, which is deleted at the end; results that need it must be written
    elsewhere by then. Gives the folder that is usual."""
    usual = session_dir(spark)
    own = f"{usual}/apart-{uuid.uuid4().hex}"
    spark.conf.set("tessera.scratch", own)
    try:
        yield usual
    finally:
        spark.conf.set("tessera.scratch", usual)
        delete(spark, own)


def release(spark: SparkSession) -> None:
    """Delete every table and file that this session wrote to the shared folder so far."""
    delete(spark, session_dir(spark))
