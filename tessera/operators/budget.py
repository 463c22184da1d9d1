"""Segments of tiles whose points fit a buffer: the greedy cuts of a sequential pass, found without one.

Tiles lie in an order; each overlaps cells of another grid, whose points were counted, and a cell counts once in a segment. A segment goes
on as long as the cells that its next tile adds fit the budget. Where a segment that began at a tile would end
is found for all tiles side by side: running sums of what cells bring where they first appear bound how far that
can be, so tiles go in blocks of a budget each, and a block with the one behind it suffices. Pointers from each start to the next
are followed from the first tile on by doubling.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import running_sums
from tessera.sources.scratch import written


def next_starts(budget: int):
    """For applyInArrow: (position, next) of a block's own tiles, by a window that moves over its tiles and those of the block behind.
    A tile that alone is above the budget is a segment."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        tiles: dict[int, list] = {}
        own = set()
        for position, cell, n, is_own in zip(rows["position"], rows["cell"], rows["n"], rows["own"], strict=True):
            tiles.setdefault(position, []).append((cell, n))
            if is_own:
                own.add(position)
        order = deque(sorted(tiles))
        window: deque[int] = deque()
        times: dict[int, int] = {}
        held, out = 0, []
        for start in sorted(own):
            while order:
                new = {c: n for c, n in tiles[order[0]] if c is not None and not times.get(c)}
                if window and held + sum(new.values()) > budget:
                    break
                held += sum(new.values())
                for c, _ in tiles[order[0]]:
                    times[c] = times.get(c, 0) + 1
                window.append(order.popleft())
            out.append((start, order[0] if order else window[-1] + 1))
            for c, n in tiles[window.popleft()]:
                times[c] -= 1
                if not times[c]:
                    del times[c]
                    held -= n or 0
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 2, ["position", "next"])

    return run


def greedy_segments(tiles: DataFrame, cover: DataFrame, budget: int) -> DataFrame:
    """tiles (position, their number in the order) with `segment` (from 0) and `before`, the points that earlier cells of the segment hold.

    cover (position, cell, n) has the cells of each tile, n their points. No segment of several tiles holds more than the budget,
    and none could take its next tile.
    """
    placed = cover.groupBy("cell").agg(F.min("position").alias("position"), F.max("n").alias("n")).groupBy("position").agg(F.sum("n").alias("fresh"))
    summed = running_sums(tiles.select("position").join(placed, "position", "left").select(F.col("position").alias("tile"), F.coalesce("fresh", F.lit(0)).alias("fresh")), ["tile"], {"ahead": F.col("fresh")})
    blocks = written(summed.select(F.col("tile").alias("position"), F.expr(f"ahead div {budget}").alias("block")), "blocks")
    rows = blocks.join(cover, "position", "left").select("position", "block", "cell", "n")
    tasks = rows.withColumn("task", F.explode(F.array(F.col("block"), F.col("block") - 1))).withColumn("own", F.col("task") == F.col("block"))
    pointers = written(tasks.select("task", "position", "cell", "n", "own").groupBy("task").applyInArrow(next_starts(budget), "position long, next long"), "pointers")
    starts = written(pointers.agg(F.min("position").alias("position")).where("position is not null"), "starts")
    jumps, known = pointers, starts.count()
    while known:
        ahead = starts.join(jumps, "position").select(F.col("next").alias("position")).join(pointers.select("position"), "position", "left_semi")
        starts = written(starts.union(ahead).distinct(), "starts")
        if (now := starts.count()) == known:
            break
        known = now
        jumps = written(jumps.join(jumps.select(F.col("position").alias("next"), F.col("next").alias("then")), "next").select("position", F.col("then").alias("next")), "jumps")
    begun = tiles.join(starts.withColumn("begins", F.lit(1)), "position", "left").withColumnRenamed("position", "tile")
    found = running_sums(begun.withColumn("begins", F.coalesce("begins", F.lit(0))), ["tile"], {"segments": F.col("begins")})
    numbered = written(found.select(*[F.col("tile").alias("position") if c == "position" else F.col(c) for c in tiles.columns], (F.col("segments") + F.col("begins") - 1).alias("segment")), "segments")
    # In a segment a cell counts where it comes first.
    once = cover.join(numbered.select("position", "segment"), "position").groupBy("segment", "cell").agg(F.min("position").alias("position"), F.max("n").alias("n"))
    new = once.groupBy("position").agg(F.sum("n").alias("new"))
    inside = Window.partitionBy("segment").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # a segment's tiles: bounded by the budget
    return numbered.join(new, "position", "left").withColumn("before", F.coalesce(F.sum("new").over(inside), F.lit(0))).drop("new")


def segment_runs(segments: DataFrame, cover: DataFrame, chunks: DataFrame) -> DataFrame:
    """(segment, start, length): the runs of consecutive chunks that hold a segment's points. chunks: (cell, chunk)."""
    wanted = segments.select("position", "segment").join(cover.select("position", "cell"), "position").join(chunks, "cell").select("segment", "chunk").distinct()
    island = F.col("chunk") - F.row_number().over(Window.partitionBy("segment").orderBy("chunk"))  # a segment's chunks only
    return wanted.withColumn("island", island).groupBy("segment", "island").agg(F.min("chunk").alias("start"), F.count("*").alias("length")).drop("island")
