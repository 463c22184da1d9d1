"""Operator 12: phrase collocations from a weighted de Bruijn graph.

The longest grams, of three words, are the edges of a graph whose nodes are pairs of words: an edge leads from a gram's first two words to
its last two, and its weight is how often it occurs. One pass counts them; where a piece of text ends, the last grams lack
words, and these shorter ones are the corrections: what flows out of a node, edges and ends together, is how often the
pair occurs, and the same sum over all nodes that begin with a word is the word's count. Nothing else is counted.

Of the frequent edges, those that follow each other through nodes with one edge in and one out are compacted to
paths, found by pointer doubling; all that is decided inside a path needs no join, and a path shows each node once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices, written

#: Fixed values of the contract: the least count of a candidate, the share (in hundredths) of it that a longer one needs to drop it,
#: and the rows of each language.
LEAST, SHARE, TOP = 10, 50, 2000
UNKNOWN = "und"
#: Words that a task counts before it hands the counts on, and different ones among them, at most: what it holds.
WORDS, VOCABULARY = 1 << 22, (1 << 21) - 1
#: Bytes of a text that are split at a time, about.
PART = 1 << 20
#: Edges in a row of a path, at most; a longer path goes on in the next row.
LONGEST_PATH = 1024
EDGE = ["lang", "w1", "w2", "w3"]
NODE = ["lang", "w1", "w2"]

# Upper-case letters become lower-case ones, ends of pieces a byte that no UTF-8 text has, tabs spaces.
END = b"\xff"
BYTES = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))


class Counts:
    """Grams of one language, as numbers of words in the order in which they came up; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {END: 0}
        self.texts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: bytes) -> None:
        """A text, a part at a time; parts end between words, and grams reach over their ends."""
        text = text.translate(BYTES)
        at = 0
        while at < len(text):
            cut = text.find(b" ", at + PART)
            cut = len(text) if cut < 0 else cut
            self.count(text[at:cut].replace(END, b" \xff ").split(b" "))
            at = cut
        self.texts.append(np.zeros(1, np.int32))
        self.words += 1

    def count(self, words: list[bytes]) -> None:
        numbers = self.numbers
        for word in set(words):
            if word not in numbers:
                numbers[word] = len(numbers)
        found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        if b"" in numbers:
            found = found[found != numbers[b""]]
        self.texts.append(found)
        self.words += len(found)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """(node, w3, n): a gram from each word on, in the order of nodes; w3 is null behind the end of a piece."""
        a = np.concatenate([*self.texts, np.zeros(2, np.int32)])
        self.texts = []
        some = a[:-2] != 0
        third = np.where(a[1:-1] == 0, 0, a[2:])[some]
        if len(self.numbers) <= VOCABULARY:
            keys = a[:-2][some].astype(np.int64)
            keys <<= 21
            keys |= a[1:-1][some]
            keys <<= 21
            keys |= third
            keys, n = np.unique(keys, return_counts=True)
            ends = lambda k: (k >> 42, k >> 21 & VOCABULARY, k & VOCABULARY)
        else:  # one text alone may have more words
            pairs, at = np.unique(a[:-2][some].astype(np.int64) << 32 | a[1:-1][some], return_inverse=True)
            keys, n = np.unique(at << 32 | third, return_counts=True)
            ends = lambda k: (pairs[k >> 32] >> 32, pairs[k >> 32] & 0xFFFFFFFF, k & 0xFFFFFFFF)
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        word = lambda k: words.take(pa.array(k - 1, mask=k == 0))
        for at in range(0, len(n), 1 << 16):
            first, second, third = ends(keys[at : at + (1 << 16)])
            begins = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
            pair = pc.binary_join_element_wise(word(first[begins]), word(second[begins]), " ", null_handling="skip")
            node = pc.binary_join_element_wise(pa.scalar(lang), pair, "\t").take(pa.array(np.cumsum(begins) - 1))
            yield pa.record_batch([node, word(third), pa.array(n[at : at + (1 << 16)])], ["node", "w3", "n"])


def grams(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(node, w3, n): the counts of grams, added up where they are read; not yet one row for each. A node is its language, a tab and
    its words with a space between them, of which the second may lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}
        words = 0
        for rows in slices(batches):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                counts = held.setdefault(lang, Counts())
                before = counts.words
                counts.add(text)
                words += counts.words - before
                if words >= WORDS or len(counts.numbers) >= VOCABULARY // 2:
                    for name, full in held.items():
                        yield from full.rows(name)
                    held, words = {}, 0
        for name, full in held.items():
            yield from full.rows(name)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(lang.alias("lang"), text.alias("text")).mapInArrow(run, "node string, w3 string, n long")


def flows(df: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, w1, w2, w3, n), written: frequent edges; with a null w3, frequent nodes with what flows out of them; with a null w2 too, what else
    the count of a word needs. Nodes are shuffled once; edges and flows are summed where they meet."""
    dealt = grams(df, text_col, lang_col).repartition("node")
    edges = dealt.groupBy("node", "w3").agg(F.sum("n").alias("n"))
    flow = F.lit(None).cast("string")
    parts = F.when((F.col("n") >= least) & F.col("w3").isNotNull(), F.array(flow, F.col("w3"))).otherwise(F.array(flow))
    sums = edges.select("node", F.explode(parts).alias("w3"), "n").groupBy("node", "w3").agg(F.sum("n").alias("n"))
    pair = F.substring_index("node", "\t", -1)
    lang = F.substring(F.col("node"), F.lit(1), F.length("node") - F.length(pair) - 1)
    second = F.when(F.col("n") >= least, F.get(F.split(pair, " "), F.lit(1)))
    named = sums.select(lang.alias("lang"), F.substring_index(pair, " ", 1).alias("w1"), second.alias("w2"), "w3", "n")
    return written(named.groupBy(*EDGE).agg(F.sum("n").alias("n")), "flows")


def nodes_and_edges(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `flows` the frequent nodes (NODE, flow) and the frequent edges (EDGE, n, and the flow of the node they begin at)."""
    nodes = counted.where("w2 is not null and w3 is null").select(*NODE, F.col("n").alias("flow"))
    return nodes, counted.where("w3 is not null").join(nodes, NODE)


def with_paths(edges: DataFrame) -> DataFrame:
    """edges (EDGE, n, flow of the first node, whether each end is unary) with `path`, the key of the path's first edge, and `place` in it.

    Each edge points to the one before it; by doubling, to the first. An edge that lies on a circle of unary nodes is a path of its own.
    """
    key = F.concat_ws("\t", *EDGE)  # words hold no tab
    node = lambda a, b: F.concat_ws("\t", "lang", a, b)
    keyed = edges.withColumns({"edge": key, "begin": node("w1", "w2"), "end": node("w2", "w3")})
    into = keyed.groupBy(F.col("end").alias("begin")).agg(F.count("*").alias("ins"), F.min("edge").alias("before"))
    out = keyed.groupBy("begin").agg(F.count("*").alias("outs"))
    unary = into.join(out, "begin").where("ins = 1 and outs = 1").select("begin", "before")
    linked = written(keyed.join(unary, "begin", "left").select("edge", *EDGE, "n", "flow", F.when(F.col("before") != F.col("edge"), F.col("before")).alias("before")), "edges")
    # Only edges with one before them move: pointers end at edges that have none.
    ways = written(linked.where("before is not null").select("edge", F.col("before").alias("to"), F.lit(1).cast("long").alias("steps")), "ways")
    most, rounds = ways.count(), 0
    while 1 << rounds <= most:
        ahead = ways.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        ways = written(ways.join(ahead, "to", "left").select("edge", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "ways")
        rounds += 1
        if not ways.join(ways.select(F.col("edge").alias("to")), "to", "left_semi").take(1):
            break
    round_ = ways.select(F.col("edge").alias("to")).distinct()
    done = ways.join(round_, "to", "left_anti").select("edge", F.col("to").alias("path"), F.col("steps").alias("place"))
    return linked.join(done, "edge", "left").select(*EDGE, "n", "flow", F.coalesce("path", "edge").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))


def paths(edges: DataFrame) -> DataFrame:
    """(lang, words, ns, flows): the edges compacted; words are one node's and the last word of each edge, ns the edges' weights,
    flows those of the nodes they begin at. At most LONGEST_PATH edges are in a row."""
    row = F.sort_array(F.collect_list(F.struct("place", "w1", "w2", "w3", "n", "flow")))
    found = with_paths(edges).groupBy("lang", "path", F.expr(f"place div {LONGEST_PATH}").alias("part")).agg(row.alias("row"))
    take = lambda name: F.transform("row", lambda x: x[name])
    words = F.concat(F.array(F.get("row", F.lit(0))["w1"], F.get("row", F.lit(0))["w2"]), take("w3"))
    return found.select("lang", words.alias("words"), take("n").alias("ns"), take("flow").alias("flows"))


def heaviest(compact: DataFrame) -> DataFrame:
    """(NODE, heaviest): the largest weight of a node's edges, those of a path's inner nodes found in its row."""
    size = F.size("ns")
    around = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("words", i).alias("w1"), F.get("words", i + 1).alias("w2"), F.greatest(F.get("ns", i - 1), F.get("ns", i)).alias("n")))
    return compact.select("lang", F.explode(around).alias("x")).groupBy("lang", F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2")).agg(F.max("x.n").alias("heaviest"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(df: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases of two or three words by score: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language `und`; a text without words adds nothing. Repeated rows count as often as they occur. An empty table,
    or one without a frequent phrase, gives none. Other columns of df are left out.
    """
    counted = flows(df, least, text_col, lang_col)
    words = written(counted.where("w3 is null").groupBy("lang", "w1").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    nodes, edges = nodes_and_edges(counted)
    compact = written(paths(edges), "paths")
    kept = nodes.select(*NODE, F.col("flow").alias("a")).join(heaviest(compact), NODE, "left").where(100 * F.coalesce("heaviest", F.lit(0)) < share * F.col("a"))
    first = words.select("lang", "w1", F.col("f").alias("f1"))
    last = lambda name: words.select("lang", F.col("w1").alias(name), F.col("f").alias("fl"))
    pairs = kept.join(first, ["lang", "w1"]).join(last("w2"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("fl").alias("r"), score(F.col("a"), F.col("f1"), F.col("fl")).alias("score"))
    steps = F.transform(F.sequence(F.lit(0), F.size("ns") - 1), lambda i: F.struct(*[F.get("words", i + k).alias(f"w{k + 1}") for k in range(3)], F.get("ns", i).alias("a"), F.get("flows", i).alias("f12")))
    triples = compact.select("lang", F.explode(steps).alias("x")).select("lang", "x.*")
    behind = nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("flow").alias("f23"))
    triples = triples.join(behind, ["lang", "w2", "w3"]).join(first, ["lang", "w1"]).join(last("w3"), ["lang", "w3"])
    cut = lambda k, left, right: F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "fl")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark keeps each task's first rows of a language before they meet.
    ranked = pairs.union(triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
