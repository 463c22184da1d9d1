"""Density of cells as points arrive: Structured Streaming keeps a count and bounds for each cell.

An extension of the batch density: files of points are a stream, the state is one row a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import grid


def stream_density(stream: DataFrame, definition: DataFrame, path: str) -> DataFrame:
    """Processes all that a stream of points (qx, qy, qz) holds now and returns the latest density of each cell.

    Each batch adds the rows of cells it changed to a folder of its own, which a repeated batch
    overwrites, so a restarted query counts nothing twice.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    counts = grid.density(grid.celled(stream, definition))
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    kept = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{path}/rows")
    latest = F.max_by(F.struct("n", "min_qz", "max_qz"), "batch").alias("v")
    return kept.groupBy("tile_row", "tile_col").agg(latest).select("tile_row", "tile_col", "v.*")
