"""Connected components of a graph by Spark joins, for the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b, of an orderable type): the
    smallest node that is reachable.

    Rounds of alternating stars: every node sends its larger neighbours to its smallest
    neighbour (large star), then its smaller neighbours and itself to the smallest (small star), until
    nothing changes. The number of edges never grows and a round about halves the
    distances. Each round is written to the shared folder, so neither lineage nor
    memory grows; nothing is gathered but a count. Minima are combined before the shuffle; the
    joins back to a node with very many edges can be split by adaptive execution.
    """
    stars = written(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges"
    )
    state = None
    while True:
        # Large star: hi neighbours of each node move to the smallest of its neighbourhood.
        both = stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        # Small star: lo neighbours of each node move to the smallest of them.
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.col("m"), F.explode(F.array("lo", "hi")).alias("hi")).where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct()
        stars = written(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # Now each node that isn't a root has one edge, to its root.
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(stars.select("lo", "lo").distinct())
