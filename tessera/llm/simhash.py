"""Operator 5: near-duplicates by SimHash, compared exactly in tiles.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against tile, in the order of their population
counts; a pair of tiles whose population counts differ by more than the radius can't hold a link and is skipped.

What meets at all is first narrowed without losing a link: two fingerprints that differ in at most `radius` bits agree in
at least one of radius + 1 segments. The distinct fingerprints that agree in a segment are a group. A group of more than
LARGE is divided again by segments of the bits that are left, so copies of a fingerprint grow with the
number of divisions, not with the size of the group. What stays large consists of fingerprints that are close to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import first_row, in_slices, row_keys, rows_with, salted_join, written
from tessera.llm.components import components

BITS = 64
#: Fingerprints in a tile of a large group, about; within a pair of tiles, blocks of SUB are compared or skipped.
TILE, SUB = 4096, 256
#: Larger groups are divided again, so often at most.
LARGE, DIVISIONS = 8 * TILE, 2


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """The XXH64 of each word shingle of a text, in order; a shorter text is one shingle."""
    parts = text.encode().lower().split()  # on bytes: A-Z only, and blanks are \x20 \x09-\x0D
    if not parts:
        return []
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(parts) - span].tolist(), ends[span:].tolist(), strict=True)]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all word shingles of a text, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        raw = np.array(hashes[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, k1, k2, fp long) for each row of df; no shuffle. Null and blank texts have fingerprint zero."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t or "", words) for t in rows.column(3).to_pylist()]
        return pa.record_batch([*rows.columns[:3], pa.array(fps, pa.int64())], ["id", "k1", "k2", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(in_slices(run), f"id {kind}, k1 long, k2 long, fp long")


def divided(groups: DataFrame, width: int, parts: int) -> DataFrame:
    """(fp, key, rest): each fingerprint once for each of `parts` segments of the `width` bits in `rest`. The key
    names the group, the segment and its bits; the new rest is what is left without them."""
    pieces = []
    for i in range(parts):
        low, high = width * i // parts, width * (i + 1) // parts
        bits = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < width else F.lit(0).cast("long")
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        pieces.append(F.struct(F.xxhash64("key", F.lit(i), bits).alias("key"), above.bitwiseOR(below).alias("rest")))
    return groups.select("fp", F.explode(F.array(*pieces)).alias("v")).select("fp", "v.*")


def near_blocks(pops_a: np.ndarray, pops_b: np.ndarray, radius: int) -> Iterator[tuple[int, int, int, int]]:
    """The pairs of blocks [i, k) of a and [j, m) of b, both in the order of population counts, that can hold a link:
    the others' counts differ by more than the radius."""
    for i in range(0, len(pops_a), SUB):
        k = min(i + SUB, len(pops_a))
        first = np.searchsorted(pops_b, pops_a[i] - radius)
        end = np.searchsorted(pops_b, pops_a[k - 1] + radius, "right")
        for j in range(int(first), int(end), 4 * SUB):
            yield i, k, j, min(j + 4 * SUB, int(end))


def by_population(fps: list[int]) -> np.ndarray:
    values = np.array(fps, "<i8").view("<u8")
    return values[np.argsort(np.bitwise_count(values), kind="stable")]


def stars_within(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between two arrays of fingerprints, in the order of population counts, connect,
    at most one for each fingerprint: links are merged to trees here, so pairs aren't emitted."""
    every = np.concatenate([a, b])
    parent = np.arange(len(every))
    for i, k, j, m in near_blocks(np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64), radius):
        apart = np.bitwise_count(a[i:k, None] ^ b[None, j:m])
        x, y = np.nonzero(apart <= radius)
        x, y = x + i, y + j + len(a)
        while len(x):  # hook the larger root under the smaller, then flatten, until all agree
            rx, ry = parent[x], parent[y]
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    child, every = np.flatnonzero(parent != np.arange(len(every))), every.view("<i8")
    return [(u, v) for u, v in zip(every[parent[child]].tolist(), every[child].tolist(), strict=True) if u != v]


def compare(radius: int):
    """For mapInArrow over rows (key, left tile, right tile, side, fp), which arrive sorted: the
    edges of each pair of tiles. A pair is gathered here; it is bounded by the size of tiles."""

    def links(sides: list[list[int]], same: bool) -> list[tuple[int, int]]:
        left = by_population(sides[0])
        right = left if same else by_population(sides[1])
        if not len(left) or not len(right) or same and len(left) < 2:
            return []
        return stars_within(left, right, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, [[], []], []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys = np.stack(columns[:3], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) else []
            bounds = [0, *cuts, len(keys)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key:
                    if key is not None:
                        out += links(sides, key[1] == key[2])
                    key, sides = now, [[], []]
                side, fp = columns[3][a:b], columns[4][a:b]
                sides[0] += fp[side == 0].tolist()
                sides[1] += fp[side == 1].tolist()
            if len(out) > 100_000:
                yield edges(out)
                out = []
        if key is not None:
            out += links(sides, key[1] == key[2])
        if out:
            yield edges(out)

    def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def groups_of(fps: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """(key, n, fp): the groups of two and more, their sizes, and their fingerprints; and the largest size."""
    parts, width = radius + 1, BITS
    large, out = fps.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), None
    for division in range(1 + DIVISIONS):
        spread = divided(large, width, parts)
        if out is not None:  # a large group's fingerprints are fewer, but are read again below
            spread = written(spread, "divided")
        width -= width // parts
        sizes = written(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("weight", F.col("n")), "group-sizes")
        grouped = salted_join(spread, sizes, ["key"], "weight")
        most = sizes.agg(F.max("n")).first()[0] or 0
        if division == DIVISIONS or most <= LARGE:
            done = grouped.select("key", "n", "fp")
            return (done, most) if out is None else (out.union(done), max(most, LARGE))
        small, large = (grouped.where(F.col("n") <= LARGE), grouped.where(F.col("n") > LARGE).select("fp", "key", "rest"))
        out = small.select("key", "n", "fp") if out is None else out.union(small.select("key", "n", "fp"))
    raise AssertionError


def tiled(groups: DataFrame) -> DataFrame:
    """groups (key, n, fp) of more than TILE with their tile, and the last tile that it has to meet.

    Tiles are runs in the order of population counts. The counts of each population in a group give the place where it
    begins; a fingerprint's place among those of its population is dealt by hash.
    """
    groups = groups.withColumn("pop", F.bit_count("fp"))
    pops = written(groups.groupBy("key", "pop").agg(F.count("*").alias("here")), "populations")
    inside = Window.partitionBy("key").orderBy("pop")
    before = F.coalesce(F.sum("here").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pops.withColumn("begin", before).withColumn("weight", F.col("here"))
    share = F.pmod(F.xxhash64("fp"), F.col("here"))
    rows = salted_join(groups, written(placed, "places"), ["key", "pop"], "weight")
    return rows.select("key", "fp", "pop", F.expr(f"begin div {TILE}").alias("first"), ((F.col("begin") + share) / TILE).cast("long").alias("tile"))


def tile_pairs(large: DataFrame, radius: int) -> DataFrame:
    """(key, left_tile, right_tile, side, fp): the rows of each pair of tiles that has to be compared."""
    # Which populations a tile holds; a tile meets itself and those that hold counts within the radius, the rest is skipped.
    spans = written(large.groupBy("key", "tile").agg(F.min("pop").alias("least"), F.max("pop").alias("most")), "tiles")
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.least") - F.col("a.most") <= radius)
    pairs = a.join(b, near).select("a.key", F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"))
    ends = F.array(F.struct(F.col("left_tile").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("right_tile").alias("tile"), F.lit(1).alias("side")))
    meets = pairs.select("*", F.explode(F.when(F.col("left_tile") == F.col("right_tile"), F.slice(ends, 1, 1)).otherwise(ends)).alias("v")).select("key", "left_tile", "right_tile", "v.*")
    by_tile = meets.groupBy("key", "tile").agg(F.collect_list(F.struct("left_tile", "right_tile", "side")).alias("meets"))
    return large.join(by_tile, ["key", "tile"]).select("key", "fp", F.explode("meets").alias("v")).select("key", "v.*", "fp")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that lie
    within `radius` bits of each other."""
    groups, most = groups_of(fps, radius)
    alone = groups.where(F.col("n") <= TILE).select("key", F.lit(0).cast("long").alias("left_tile"), F.lit(0).cast("long").alias("right_tile"), F.lit(0).alias("side"), "fp")
    keys = ["key", "left_tile", "right_tile"]
    dealt = alone if most <= TILE else alone.union(tile_pairs(tiled(groups.where(F.col("n") > TILE)), radius))
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.select(*keys, "side", "fp").mapInArrow(compare(radius), "a long, b long")


def grouped(df: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, k1, k2, fp), written, and (fp, n, first): for each distinct fingerprint how many rows have it, and
    the first row of its component."""
    rows = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(first_row("id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct, radius))
    best = found.join(distinct, found.node == distinct.fp).groupBy("component").agg(F.min("first").alias("best"))
    linked = found.join(best, "component").select(F.col("node").alias("fp"), "best")
    return rows, written(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("best", "first").alias("first")), "reach")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of df: the smallest id that is reachable over links of at
    most `radius` differing bits, itself included.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints
    are collapsed to one before anything is compared, so copies cost nothing.
    Rows with a null id keep a null component of their own unless linked to others. Repeated rows give repeated results; an empty table gives none;
    other columns are left out. The table of (id, fingerprint) is written to the shared folder.
    """
    rows, reach = grouped(df, id_col, text_col, words, radius)
    facts = reach.select("fp", "n", F.col("first.id").alias("component_id"))
    return salted_join(rows.select("id", "fp"), facts, ["fp"], "n").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of df without near-duplicates: of each component, the row with the smallest id. Of rows
    that share an id, one of each component stays; of rows equal in id and text, one. A null id comes after all others."""
    _, reach = grouped(df, id_col, text_col, words, radius)
    return rows_with(df, reach.select("first.k1", "first.k2").distinct(), id_col, text_col)
