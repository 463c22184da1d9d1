"""Operator 10: packing documents into training sequences by lexical retrieval.

A document's full windows are sequences of their own; what is left, its tail, is packed. Documents are dealt to
shards of bounded size by lexical closeness: a tree over their BM25 vectors. In each shard an inverted index of the
documents with BM25 weights returns, for the one that opens a window, its nearest ones whose tails haven't been used;
they fill the window in that order. The last one is cut, and its rest opens the next window, so windows have no gaps.
Terms, lengths and queries are those of whole documents; document frequencies and the mean length those of all
documents of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import Bpe
from tessera.llm.common import slices, written

WINDOW = 1024
END = 0
#: Tails in a shard of the index, about.
SHARD = 4096
#: BM25.
K1, B = 1.2, 0.75
#: A term in more than one of so many documents of a shard is common: its weights are a row for all of them, in so many bytes altogether.
COMMON, ROWS = 50, 32 << 20
#: Scores are sums in single precision: smaller ones are none.
LEAST = 1e-3
#: Vectors that the tree of shards is grown on, about, and their coordinates.
SAMPLE, DIMENSIONS = 16_000, 256
VOCABULARY = 1 << 16


@cache
def encoder(path: str) -> tuple[tiktoken.Encoding, Bpe]:
    """A compiled encoder for the byte-level vocabulary of a tokenizer.json. Its tokens are merged in the order of
    their ids, so these must follow the order of the merges."""
    coder = Bpe(path)
    if coder.byte_decoder is None or any((a & 0xFFFFFFFF) >= (b & 0xFFFFFFFF) for a, b in pairwise(coder.pairs.values())):
        raise ValueError("a byte-level vocabulary with ids in the order of its merges is needed")
    if max(coder.strings) >= VOCABULARY:
        raise ValueError("ids of tails are kept in 16 bits")
    ranks = {raw: i for i, raw in coder.byte_decoder.items() if i not in coder.special.values()}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=coder.special), coder


def encoded(text: str, path: str) -> np.ndarray:
    """A document's ids, strings of special tokens among them, and the end id."""
    plain, coder = encoder(path)
    specials = set(coder.special) if coder.has_special(text) else set()
    return np.append(plain.encode_to_numpy(text, allowed_special=specials, disallowed_special=()), np.uint32(END)).astype("<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(df: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """For each row: doc_id, doc_tokens, the checksums of its full windows, the tail's ids as 16-bit
    integers, `before`: how many numbers the earlier rows of its task take (one for each
    full window, and one more), and the distinct ids of the whole document with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for rows in slices(batches, 256):
            tokens, full, tails, places, terms, counts = [], [], [], [], [], []
            for text in rows.column(1).to_pylist():
                ids = encoded(text or "", tokenizer)
                cut = len(ids) // WINDOW * WINDOW
                tokens.append(len(ids))
                full.append([crc(ids[i : i + WINDOW]) for i in range(0, cut, WINDOW)])
                tails.append(ids[cut:].astype("<u2").tobytes())
                found, often = np.unique(ids.astype("<u2"), return_counts=True)
                terms.append(found.tobytes())
                counts.append(often.astype("<u4").tobytes())
                places.append(before)
                before += len(full[-1]) + 1
            yield pa.record_batch(
                [rows.column(0), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(places, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "doc_tokens", "full", "tail", "before", "terms", "counts"],
            )

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, tail binary, before long, terms binary, counts binary")


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many documents each id of the vocabulary occurs, over all rows: each task sums
    a vector as long as the vocabulary; their sums, one row for each id, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums[np.frombuffer(raw, "<u2")] += 1
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["term", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def weights(often: np.ndarray, length: np.ndarray | int, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weights of terms that occur so often in documents of these lengths."""
    norm = K1 * (1 - B + B * length / max(mean_length, 1))
    return (idf * often * (K1 + 1) / (often + norm)).astype(np.float32)


class Index:
    """An inverted index of one shard: for each term its documents and their BM25 weights. Documents are given by
    their ids, or by their distinct terms and counts. Common terms have a weight for every document, so that adding one up
    is a sum of two rows."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean_length: float, counted: list[tuple[np.ndarray, np.ndarray]] | None = None):
        counted = counted or [np.unique(t, return_counts=True) for t in texts]
        self.queries, lengths = [t for t, _ in counted], np.array([n.sum() for _, n in counted])
        sizes = np.array([len(t) for t in self.queries], np.int64)
        term, often = np.concatenate(self.queries).astype(np.int64), np.concatenate([n for _, n in counted]).astype(np.float32)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        weight = weights(often, lengths[doc], idf[term], mean_length)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        starts = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        found = np.diff(starts)
        most = np.argsort(-found, kind="stable")[: ROWS // (4 * max(1, len(sizes)))]
        self.rows: dict[int, np.ndarray] = {}
        for t in most[found[most] * COMMON > len(sizes)].tolist():
            row = self.rows[t] = np.zeros(len(sizes), np.float32)
            row[self.docs[starts[t] : starts[t + 1]]] = self.weights[starts[t] : starts[t + 1]]
        self.starts = starts
        # A seed has most of the terms that over half of the documents have: it's quicker to take off those that it lacks.
        self.usual = frozenset(t for t in self.rows if 2 * found[t] > len(sizes))
        self.base = sum((self.rows[t] for t in self.usual), np.zeros(len(sizes), np.float32))
        self.narrow(np.arange(len(sizes)))

    def narrow(self, alive: np.ndarray) -> None:
        """From now on only documents `alive`, their numbers in order, are scored."""
        if hasattr(self, "alive"):
            kept = np.zeros(len(self.queries), bool)
            kept[alive] = True
            kept = kept[self.alive]
            number = np.cumsum(kept, dtype=np.int32) - 1
            stay = kept[self.docs]
            self.starts = np.concatenate([[0], np.cumsum(stay)])[self.starts]
            self.docs, self.weights = number[self.docs[stay]], self.weights[stay]
            self.rows = {t: row[kept] for t, row in self.rows.items()}
            self.base = self.base[kept]
        self.alive, self.begins = alive, self.starts.tolist()
        self.scores = np.zeros(len(alive), np.float32)

    def scored(self, seed: int) -> np.ndarray:
        """The BM25 scores of the documents alive for the seed's terms, all of them. The array is used again."""
        scores, rows, starts, terms = self.scores, self.rows, self.begins, self.queries[seed].tolist()
        usual = self.usual.intersection(terms)
        if 2 * len(usual) > len(self.usual):
            np.copyto(scores, self.base)
            for t in self.usual - usual:
                np.subtract(scores, rows[t], out=scores)
            terms = [t for t in terms if t not in usual]
        else:
            scores[:] = 0
        for t in terms:
            row = rows.get(t)
            if row is not None:
                np.add(scores, row, out=scores)
            else:
                a, b = starts[t], starts[t + 1]
                scores[self.docs[a:b]] += self.weights[a:b]
        return scores

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The unused documents that share terms of a weight above LEAST with the seed, nearest first; ties in the order of rows. Documents once used
        mustn't be asked for again: when half of those alive are used, the index narrows to the others."""
        free = unused[self.alive]
        if 2 * np.count_nonzero(free) <= len(free):
            self.narrow(self.alive[free])
            free = np.ones(len(self.alive), bool)
        scores, alive = self.scored(seed), self.alive
        found, width = np.flatnonzero((scores > LEAST) & free), 32
        while len(found):
            if len(found) > width:
                # All that are as near as the last of the first ones go along, so that ties stay in order.
                least = -np.partition(-scores[found], width - 1)[width - 1]
                near = scores[found] >= least
                head, found = found[near], found[~near]
            else:
                head, found = found, found[:0]
            yield from alive[head[np.lexsort((head, -scores[head]))]].tolist()
            width *= 2


@cache
def directions() -> np.ndarray:
    """A random direction for each term; sums of them keep the angles between documents, about."""
    return np.random.default_rng(11).standard_normal((VOCABULARY, DIMENSIONS), np.float32)


def placed(terms: bytes, counts: bytes, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """A document's BM25 weights as a short vector of length 1."""
    term, often = np.frombuffer(terms, "<u2"), np.frombuffer(counts, "<u4")
    v = weights(often, often.sum(), idf[term], mean_length) @ directions()[term]
    return v / max(float(np.linalg.norm(v)), 1e-9)


class Tree:
    """Cells of lexically near documents, of about SHARD at most, from a sample of their vectors.

    A cell is divided between its two centres (of 2-means), at the widest gap of the sample near its middle, so
    groups that lie close stay together. A cell of equal vectors can't be divided so: its documents are all alike
    and are dealt by their rows."""

    def __init__(self, sample: np.ndarray, documents: int):
        self.nodes: list[tuple] = []  # (direction, threshold, child below, child above), or (parts, first shard)
        self.shards = 0
        self.grow(sample.astype(np.float32), documents / max(1, len(sample)))

    def grow(self, v: np.ndarray, each: float) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        cut = self.cut(v) if len(v) * each > 0.75 * SHARD and len(v) > 3 else None
        if cut is None:
            parts = -(-int(len(v) * each) // SHARD) if len(v) * each > 4 * SHARD else 1
            self.nodes[at] = (parts, self.shards)
            self.shards += parts
        else:
            direction, threshold = cut
            above = v @ direction > threshold
            self.nodes[at] = (direction, threshold, self.grow(v[~above], each), self.grow(v[above], each))
        return at

    @staticmethod
    def cut(v: np.ndarray) -> tuple[np.ndarray, float] | None:
        one = v[np.argmin(v @ v.mean(0))]  # lengths are 1: the farthest has the smallest product
        two = v[np.argmin(v @ one)]
        for _ in range(10):
            above = v @ (two - one) > (two @ two - one @ one) / 2
            if above.all() or not above.any():
                break
            one, two = v[~above].mean(0), v[above].mean(0)
        along = np.sort(v @ (two - one))
        if along[-1] - along[0] < 1e-5:
            return None
        # The widest gap between the quarters; where all of that is equal, the widest of all.
        for low, high in ((len(v) // 4, len(v) - len(v) // 4), (0, len(v))):
            gaps = np.diff(along[low:high])
            if len(gaps) and gaps.max() > 1e-6:
                i = low + int(gaps.argmax())
                return two - one, float((along[i] + along[i + 1]) / 2)
        return None

    def shard(self, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            at, which = todo.pop()
            node = self.nodes[at]
            if len(node) == 2:
                out[which] = node[1] + rows[which] % node[0]
            elif len(which):
                above = v[which] @ node[0] > node[1]
                todo += [(node[2], which[~above]), (node[3], which[above])]
        return out


def dealt(tails: DataFrame, documents: int, idf: np.ndarray, mean_length: float) -> DataFrame:
    """tails (row, doc_tokens, tail, terms, counts) with `shard`: that of a tree grown on a sample of
    at most about SAMPLE vectors, which come to the driver."""
    if documents <= SHARD:
        return tails.withColumn("shard", F.lit(0).cast("long"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            v = [placed(t, n, idf, mean_length).astype(np.float16).tobytes() for t, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([rows.column(2), pa.array(v, pa.binary())], ["row", "v"])

    share = -(-documents // SAMPLE)
    some = tails.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("terms", "counts", "row").mapInArrow(vectors, "row long, v binary").collect()
    sample = np.array([np.frombuffer(r.v, np.float16) for r in sorted(some)]).reshape(-1, DIMENSIONS)
    tree = Tree(sample, documents)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            v = np.array([placed(t, n, idf, mean_length) for t, n in zip(rows.column("terms").to_pylist(), rows.column("counts").to_pylist(), strict=True)])
            yield rows.append_column("shard", pa.array(tree.shard(v.reshape(-1, DIMENSIONS), rows.column("row").to_numpy())))

    return tails.mapInArrow(deal, "row long, doc_tokens long, tail binary, terms binary, counts binary, shard long")


def fill(rows: pd.DataFrame, idf: np.ndarray, mean_length: float) -> pd.DataFrame:
    """The pieces of one shard's tails (row, start, length, ids_crc32, lead, offset); lead is the row whose
    piece opens the sequence."""
    rows = rows.sort_values("row", ignore_index=True)
    tails = [np.frombuffer(t, "<u2") for t in rows["tail"]]
    counted = [(np.frombuffer(t, "<u2"), np.frombuffer(n, "<u4")) for t, n in zip(rows["terms"], rows["counts"], strict=True)]
    index = Index(tails, idf, mean_length, counted)
    unused = np.ones(len(rows), bool)
    names, start_of = rows["row"].to_numpy(), (rows["doc_tokens"] - [len(t) for t in tails]).to_numpy()
    out: list[tuple] = []
    following, seed, used = 0, -1, 0

    def put(doc: int, begin: int, length: int, lead: int, offset: int) -> None:
        piece = tails[doc][begin : begin + length]
        out.append((names[doc], start_of[doc] + begin, length, crc(piece), names[lead], offset))

    while True:
        if seed < 0:  # no rest of a cut document opens this window: the next unused one does
            while following < len(tails) and not unused[following]:
                following += 1
            if following == len(tails):
                break
            seed, used = following, 0
            unused[seed] = False
        lead = seed
        filled = len(tails[seed]) - used
        put(seed, used, filled, lead, 0)
        seed = -1

        def candidates(lead: int = lead) -> Iterator[int]:
            yield from index.ranked(lead, unused)
            for i in range(following, len(tails)):  # nothing lexically near is left
                if unused[i]:
                    yield i

        if filled < WINDOW:
            for doc in candidates():
                unused[doc] = False
                room = WINDOW - filled
                length = min(room, len(tails[doc]))
                put(doc, 0, length, lead, filled)
                filled += length
                if length < len(tails[doc]):
                    seed, used = doc, length
                if filled == WINDOW:
                    break
    return pd.DataFrame(out, columns=["row", "start", "length", "ids_crc32", "lead", "offset"])


def numbering(rows: DataFrame) -> DataFrame:
    """rows with `row`: how many numbers all rows before it take, in the order of the written parts. The sums
    of parts, a few rows, are added up; within a part the tasks have counted."""
    parts = rows.groupBy("part").agg(F.sum(F.size("full") + 1).alias("takes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("takes").over(earlier), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(firsts), "part").withColumn("row", F.col("first") + F.col("before")).drop("first")


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are those of the byte-level tokenizer.json at `tokenizer`, with 0 after each document; a null text has
    that id only. Sequences hold WINDOW ids, but the last of each shard. Each row is a document
    of its own, rows with equal or null ids as well. An empty table gives no pieces. Other columns are left out.
    Sequences are numbered from the rows: each row has a number for each full window and one for the sequence
    that its tail opens, if it does.
    """
    rows = written(tokenized(df, tokenizer, id_col, text_col).withColumn("part", F.spark_partition_id()), "tokenized")
    facts = rows.agg(F.count("*").alias("n"), F.avg("doc_tokens").alias("mean"), F.count_if(F.length("tail") > 0).alias("tails")).first()
    numbered = numbering(rows)
    whole = numbered.select("doc_id", "doc_tokens", "row", F.posexplode("full").alias("window", "ids_crc32")).select(
        "doc_id", (F.col("window") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("row") + F.col("window")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    often = document_frequencies(rows)
    idf = np.log1p((facts.n - often + 0.5) / (often + 0.5)).astype(np.float32)
    mean = float(facts.mean or 1)

    def shard(pieces: pd.DataFrame) -> pd.DataFrame:
        return fill(pieces, idf, mean)

    tails = numbered.where(F.length("tail") > 0).select("row", "doc_tokens", "tail", "terms", "counts")
    made = dealt(tails, facts.tails, idf, mean).groupBy("shard").applyInPandas(shard, "row long, start long, length long, ids_crc32 long, lead long, offset long")
    owners = numbered.select("row", "doc_id", "doc_tokens", F.size("full").alias("windows"))
    leads = owners.select(F.col("row").alias("lead"), (F.col("row") + F.col("windows")).alias("sequence_id"))
    rest = made.join(owners.drop("windows"), "row").join(leads, "lead").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return whole.union(rest)
