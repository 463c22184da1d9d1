"""Connected components of a graph of labels, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that can be reached.

    In turns each node's larger neighbours, then its smaller ones and itself, move to the smallest of its neighbourhood. Rounds are few
    (distances about halve), each is a table in the shared folder, and the number of edges never grows."""
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select("high", "low")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("to"))
        up = both.where("near > node").join(least, "node").where("to <> near").select(F.col("to").alias("low"), F.col("near").alias("high")).distinct()
        down = up.groupBy("high").agg(F.min("low").alias("to"))
        links = written(up.join(down, "high").select("to", F.explode(F.array("low", "high")).alias("node")).where("to <> node").select(F.col("to").alias("low"), F.col("node").alias("high")).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(links.select("low", "low").distinct())
