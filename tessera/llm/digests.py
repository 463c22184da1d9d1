"""Operator 11: document fingerprints of improbable features.

A feature is a window of 64 bytes of a text. Its entropy falls into one of 1000 classes; how rare a class is among all windows of the corpus
ranks it, and classes of low entropy, which runs and tables have, come last whatever their number. Of every 64
windows in a row the rarest, the leftmost of them, gets a point; windows of 16 points and more are the text's features. So both
what is chosen and where depends on the bytes near by only, and an edit changes features near it.

Different features, in the order of the text, go into a chain of Bloom filters of 2048 bits, 160 in each, five bits a feature. Two
fingerprints are compared filter by filter: the overlap beyond what chance gives, relative to the largest possible; each
filter of the shorter chain counts with its best counterpart, by the bits it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_slices, slices, written

#: Bytes of a feature, and windows that compete for a point.
WINDOW = 64
#: Points that make a window a feature.
POINTS = 16
#: Classes of entropy; those below LOW are ranked behind all others.
CLASSES, LOW = 1000, 100
#: Bits of a filter, features in it at most, and bits that a feature sets.
BITS, FEATURES, HASHES = 2048, 160, 5
#: Overlaps within so many standard deviations of chance are none.
MARGIN = 3.0
#: Bytes of a text that are worked on at a time.
BLOCK = 1 << 16
#: Count times its logarithm, in 65536ths, so that sums are exact.
UNIT = 1 << 16
TERMS = np.array([0, *[round(c * np.log2(c) * UNIT) for c in range(1, WINDOW + 1)]], np.int64)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of each window of WINDOW bytes; of a shorter text, of the whole. From one window to the next a byte goes and
    one comes: what their numbers in the window add to the entropy is summed up."""
    n = len(data)
    width = min(WINDOW, n)
    if not n:
        return np.zeros(0, np.int64)
    behind = np.zeros(n, np.uint8)  # equal bytes among the next width - 1
    ahead = np.zeros(n, np.uint8)  # and among those before
    for d in range(1, width):
        same = (data[:-d] == data[d:]).view(np.uint8)
        behind[:-d] += same
        ahead[d:] += same
    counts = np.bincount(data[:width], minlength=1)
    total = np.empty(n - width + 1, np.int64)
    total[0] = TERMS[counts].sum()
    if n > width:
        gone = TERMS[behind[: n - width]] - TERMS[behind[: n - width] + 1]
        # The byte that comes may equal the one that goes, which is then no longer in the window.
        come = TERMS[ahead[width:] + 1] - TERMS[ahead[width:]]
        total[1:] = total[0] + np.cumsum(gone + come)
    most = round(width * np.log2(width) * UNIT)
    return (most - total) * CLASSES // (WINDOW * 6 * UNIT + 1) if most else np.zeros(1, np.int64)


def in_blocks(data: np.ndarray) -> np.ndarray:
    """The classes of all windows, a block of bytes at a time."""
    parts = [entropy_classes(data[at : at + BLOCK + WINDOW - 1]) for at in range(0, max(len(data) - WINDOW + 1, 1), BLOCK)]
    return np.concatenate(parts)


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each class, 0 the rarest, from all windows of all texts: a count for each class reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for rows in slices(batches):
            for data in rows.column(0).to_pylist():
                counts += np.bincount(in_blocks(np.frombuffer(data, np.uint8)), minlength=CLASSES)
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found), pa.array(counts[found])], ["class", "n"])

    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    got = texts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for r in got:
        counts[r[0]] = r.n
    order = np.lexsort((np.arange(CLASSES), counts, np.arange(CLASSES) < LOW))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    return ranks


def features(data: bytes, ranks: np.ndarray) -> list[int]:
    """The hashes of a text's features, different ones, in the order of the text."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    places = np.arange(BLOCK + 3 * WINDOW, dtype=np.int64)
    classes = ranks[in_blocks(raw)]
    points = np.zeros(len(classes), np.int32)
    worst = np.full(WINDOW - 1, CLASSES, np.int64)
    padded = np.concatenate([worst, classes, worst])  # windows at the ends compete as often as others
    for at in range(0, len(padded) - WINDOW + 1, BLOCK):
        part = padded[at : at + BLOCK + WINDOW - 1]
        key = part << 32 | places[: len(part)]
        step = 1
        while step < WINDOW:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        won = (key & 0xFFFFFFFF) + at - (WINDOW - 1)
        low = int(won.min())
        some = np.bincount(won - low)
        points[low : low + len(some)] += some.astype(np.int32)
    width = min(WINDOW, len(data))
    return list(dict.fromkeys(xxhash.xxh3_64_intdigest(data[p : p + width]) for p in np.flatnonzero(points >= POINTS).tolist()))


def digest(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """A text's chain of filters, a row of bytes each; none for an empty text."""
    found = np.array(features(data, ranks), np.uint64)
    filters = np.zeros((-(-len(found) // FEATURES), BITS), bool)
    row = np.arange(len(found)) // FEATURES
    for k in range(HASHES):
        filters[row, (found >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(filters, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0, no more in common than by chance, to 1: the overlaps of the shorter chain's filters with their best counterparts. Two empty
    chains are alike, an empty one is like no other. It is the same in either order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.tobytes() == b.tobytes():
        return 1.0
    if (len(a), int(np.bitwise_count(a).sum()), a.tobytes()) > (len(b), int(np.bitwise_count(b).sum()), b.tobytes()):
        a, b = b, a
    size_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    total, weight = 0.0, 0
    wide_b = np.unpackbits(b, axis=1).astype(np.float32)
    for at in range(0, len(a), 64):
        part = np.unpackbits(a[at : at + 64], axis=1).astype(np.float32)
        size_a = part.sum(1).astype(np.int64)
        common = part @ wide_b.T
        chance = size_a[:, None] * size_b[None, :] / BITS
        spread = np.sqrt(chance * (1 - size_a[:, None] / BITS) * (1 - size_b[None, :] / BITS))
        most = np.minimum(size_a[:, None], size_b[None, :])
        share = np.where(common > chance + MARGIN * spread, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        total += float((share.max(1) * size_a).sum())
        weight += int(size_a.sum())
    return min(1.0, total / weight)


def fingerprints(df: DataFrame, ranks: np.ndarray, text_col: str = "text") -> DataFrame:
    """df with `fingerprint`, the bytes of the chain of each whole text; a null text is empty, as is its chain. No shuffle. A column of
    df with that name is replaced."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")

    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(lambda t: digest(t, ranks).tobytes())

    return df.withColumn("fingerprint", run(text))


def edited(text: str, other: str) -> str:
    """The last half of a text's characters replaced by the first as many of another, or all."""
    n = len(text)
    return text[: n - n // 2] + other[: n // 2]


def compared(df: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row: its fingerprint held against
    that of its edited text and that of the next document, by descending id; after the last comes the first.

    Rows that share an id, or have none (these come last), go by their texts. Texts are dealt once, by ranges of ids; in a
    task each row meets the one behind it, and the last row of each task the first of the next one, in a second step
    that holds two texts a task. Null texts are empty, an only row is its own next one, an empty table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    order = [F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = f"part int, kind string, id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"

    def judged(text: str, own: np.ndarray, other: str, theirs: np.ndarray) -> tuple:
        new = edited(text, other).encode()
        changed = digest(new, ranks)
        return len(text), hashlib.sha256(new).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, theirs)

    def batch(rows: list[tuple], id_type: pa.DataType, part: int) -> pa.RecordBatch:
        types = [pa.int32(), pa.string(), id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        columns = zip(*[(part, *r) for r in rows], strict=True)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split(" ")[0] for f in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for given in slices(batches, 128):
            out = []
            for key, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                own = digest(text.encode(), ranks)
                if before is None:
                    out.append(("first", key, None, None, None, None, None, None, text))
                else:
                    out.append(("row", before[0], *judged(before[1], before[2], text, own), None))
                before = key, text, own
            yield batch(out, given.column(0).type, part)
        if before is not None:
            yield batch([("last", before[0], None, None, None, None, None, None, before[1])], given.column(0).type, part)

    found = written(dealt.select("id", "text").mapInArrow(run, ddl), "fingerprints")
    firsts = found.where("kind = 'first'").select("part", F.col("text").alias("other"))
    lasts = found.where("kind = 'last'").select("part", "id", "text")
    # A row for each task: which one comes next. Bounded by the number of partitions.
    number = F.row_number().over(Window.orderBy("part"))
    parts = firsts.select("part").withColumn("k", number)
    ahead = parts.crossJoin(F.broadcast(parts.agg(F.max("k").alias("all")))).select("part", (F.col("k") % F.col("all") + 1).alias("k"))
    ends = lasts.join(ahead, "part").join(parts.select(F.col("part").alias("next"), "k"), "k").join(firsts.withColumnRenamed("part", "next"), "next")

    def run_ends(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text, other in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            own, theirs = (digest(t.encode(), ranks) for t in (text, other))
            out.append(("row", key, *judged(text, own, other, theirs), None))
        return batch(out, rows.column(0).type, 0)

    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ended = ends.select("id", "text", "other").mapInArrow(in_slices(run_ends, 16), ddl)
    return found.where("kind = 'row'").select(*columns).union(ended.select(*columns)).withColumnRenamed("id", id_col)
