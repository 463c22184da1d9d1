"""Operator 7: approximate nearest neighbours by NN-descent.

The graph of neighbours starts from tiles of vectors that are close along random directions. Each round
is a Spark join: the neighbours of a node (in either direction) are introduced to each other,
and every node keeps its K best. Queries walk the finished graph greedily: from a node to its
neighbours, expanding the best of a beam, by joins as well. Graph and beams hold ids; vectors
are joined to blocks of nodes in half precision, and the results are scored again in double
precision on the original vectors.

Equal vectors are one node, however many there are, and the smallest ids of each stand ready for
the results, so ties are exact. For inner products of vectors of unequal length, a further
coordinate makes lengths equal, so that the graph's nearness is a metric. The length that is made equal to is one
that few vectors exceed; these have no such coordinate and stay longer, as near to others as inner products make them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, slices, written

K = 40
REVERSE = 40
#: Descent ends when so small a share of edges is new, or after so many rounds.
SETTLED, ROUNDS = 0.03, 12
#: Best pairs that a member of a local join reports in a round.
REPORT = 6
BEAM = 160
#: The walk ends when so small a share of the beams' places is new, or after so many hops.
ARRIVED, HOPS = 0.02, 10
#: Of all vectors, the share that may be longer than the length made equal to; in the graph at most so many times.
LONGER, LONGEST = 0.001, 64.0
TILE = 256
#: Nodes whose lists or vectors one task holds at a time.
BLOCK = 2000


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<double>): rows with an id and a finite vector that isn't zero, of the
    most frequent length."""
    x = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return rows.where(F.size("x") == (size.n if size else 0))


def packed(nodes: DataFrame, even: float, dims: int, seed: int = 7) -> DataFrame:
    """(node, v binary, code1, code2): half-precision vectors of equal length, and the signs along two
    sets of random directions as sort keys."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((2, dims + 1, 30)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 2048):
            x = np.array(rows.column(1).to_pylist(), np.float64).reshape(rows.num_rows, dims)
            peak = np.abs(x).max(1, keepdims=True)  # squares of what isn't near 1 could overflow or vanish
            length = peak[:, 0] * np.sqrt(((x / peak) ** 2).sum(1))
            x *= (np.minimum(length / even, LONGEST) / length)[:, None]
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
            v = np.hstack([x, rest[:, None]]).astype(np.float16)
            codes = [((v.astype(np.float32) @ p > 0) @ (1 << np.arange(30, dtype=np.int64))).astype(np.int64) for p in planes]
            yield pa.record_batch([rows.column(0), pa.array([r.tobytes() for r in v], pa.binary()), *map(pa.array, codes)], ["node", "v", "code1", "code2"])

    return nodes.select("node", "x").mapInArrow(run, "node long, v binary, code1 long, code2 long")


def matrix(raw, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), dims).astype(np.float32)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def first_edges(vectors: DataFrame, code: str, nodes: int, dims: int) -> DataFrame:
    """Edges (a, b, s) inside tiles of TILE vectors that follow each other in the order of a code."""
    ordered = vectors.repartitionByRange(max(1, nodes // BLOCK), code, "node").sortWithinPartitions(code, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, TILE):
            ids, v = rows.column(0).to_numpy(), matrix(rows.column(1).to_pylist(), dims)
            s = v @ v.T
            np.fill_diagonal(s, -np.inf)
            top = best(s, min(K, len(ids) - 1)) if len(ids) > 1 else np.zeros((len(ids), 0), np.int64)
            a = np.repeat(ids, top.shape[1])
            yield pa.record_batch([pa.array(a), pa.array(ids[top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.float32))], ["a", "b", "s"])

    return ordered.select("node", "v").mapInArrow(run, "a long, b long, s float")


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges (a, b, s, new) of each node: equal edges are merged and each task drops what can't be among
    the best before the shuffle, so that a node named by very many others does no harm. An edge that was known isn't new."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("a", "b", "s", "new")


def neighbourhoods(graph: DataFrame, salt: int) -> DataFrame:
    """(centre, members): neighbours of each node, and up to REVERSE nodes that have it as a neighbour."""
    w = Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(salt)))
    back = graph.withColumn("place", F.row_number().over(w)).where(F.col("place") <= REVERSE)
    met = graph.select(F.col("a").alias("centre"), F.col("b").alias("member")).union(back.select(F.col("b").alias("centre"), F.col("a").alias("member")))
    return met.groupBy("centre").agg(F.sort_array(F.collect_set("member")).alias("members"))


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def serve(key: tuple, requests: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """What the blocks ask of a home's nodes, one row for each block: ids, vectors, and worst scores, packed."""
    held = held.sort_values("node")
    ids, v, worst = held["node"].to_numpy(), held["v"].to_numpy(), held["worst"].to_numpy(np.float32)
    places = [np.searchsorted(ids, np.sort(nodes)) for nodes in requests["nodes"]]
    return pd.DataFrame({
        "block": requests["block"].to_numpy(), "nodes": [ids[at].tobytes() for at in places],
        "v": [b"".join(v[at]) for at in places], "worst": [worst[at].tobytes() for at in places],
    })


def round_of_descent(graph: DataFrame, placed: DataFrame, blocks: int, dims: int, salt: int) -> DataFrame:
    """One round: the members of each neighbourhood meet; each member reports its best acquaintances
    that beat the worst of its present neighbours. The new graph, written.

    Vectors travel from the homes of nodes to blocks of centres, all that a block needs of a home in one
    row; a block needs at most K + REVERSE of them for each centre, and each once."""
    lists = neighbourhoods(graph, salt).withColumn("block", block_of("centre", blocks))
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= K, F.min("s")).alias("worst"))
    known = placed.join(worst, F.col("node") == F.col("a"), "left").select("home", "node", "v", F.coalesce("worst", F.lit(-9.0).cast("float")).alias("worst"))
    asked = lists.select("block", F.explode("members").alias("node"))
    requests = asked.groupBy(block_of("node", blocks).alias("home"), "block").agg(F.collect_set("node").alias("nodes"))
    parts = requests.groupBy("home").cogroup(known.groupBy("home")).applyInPandas(serve, "block int, nodes binary, v binary, worst binary")

    def meet(key: tuple, centres: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        ids, floor = (np.frombuffer(b"".join(parts[name]), kind) for name, kind in (("nodes", np.int64), ("worst", np.float32)))
        order = np.argsort(ids)
        ids, floor, v = ids[order], floor[order], np.frombuffer(b"".join(parts["v"]), np.float16).reshape(len(ids), dims)[order].astype(np.float32)
        a, b, s = [], [], []
        for group in centres["members"]:
            at = np.searchsorted(ids, np.asarray(group))
            x = v[at]
            scores = x @ x.T
            np.fill_diagonal(scores, -np.inf)
            top = best(scores, REPORT)
            found = np.take_along_axis(scores, top, 1)
            row, column = np.nonzero(found > floor[at][:, None])
            a.append(at[row])
            b.append(at[top[row, column]])
            s.append(found[row, column])
        a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, s))
        # A pair may meet in several neighbourhoods of the block.
        _, once = np.unique(a.astype(np.int64) * len(ids) + b, return_index=True)
        return pd.DataFrame({"a": ids[a[once].astype(np.int64)], "b": ids[b[once].astype(np.int64)], "s": s[once].astype(np.float32)})

    news = lists.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(meet, "a long, b long, s float")
    known = graph.select("a", "b", "s", F.lit(0).alias("new"))
    better = written(strongest(known.union(news.withColumn("new", F.lit(1))), K), "graph")
    forget(graph.sparkSession)
    return better


def build(vectors: DataFrame, placed: DataFrame, blocks: int, nodes: int, dims: int) -> DataFrame:
    """The graph: (a, b, s), up to K rows for each node."""
    starts = first_edges(vectors, "code1", nodes, dims).union(first_edges(vectors, "code2", nodes, dims))
    graph = written(strongest(starts.withColumn("new", F.lit(1)), K), "graph")
    for number in range(ROUNDS if nodes > TILE else 0):
        graph = round_of_descent(graph, placed, blocks, dims, number)
        if graph.agg(F.avg("new")).first()[0] <= SETTLED:
            break
    return graph


def walk(graph: DataFrame, placed: DataFrame, starts: DataFrame, blocks: int, dims: int, wide: int = BEAM) -> DataFrame:
    """(query, w, s): the beam of each query (a node) after a greedy search from its own node.

    A hop expands half a beam, `wide`, of the best nodes in it that haven't been expanded; what hasn't been seen is
    scored, block by block of the nodes' ids, and the best stay. It goes on until hardly anything new comes
    into the beams."""
    near = written(neighbourhoods(graph, -1), "near")
    asked = written(starts.join(placed, F.col("query") == F.col("node")).select("query", F.col("v").alias("q")), "asked")
    # Seen nodes: those of the beam and all that have been scored (kept with their round).
    beam = starts.select("query", F.col("query").alias("w"), F.lit(9.0).cast("float").alias("s"), F.lit(False).alias("expanded"))
    seen = starts.select("query", F.col("query").alias("w"))

    def score(key: tuple, pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("node")
        ids, v = held["node"].to_numpy(), matrix(held["v"].to_list(), dims)
        query, w, s = [], [], []
        for one, q, group in zip(pairs["query"], pairs["q"], pairs["ws"], strict=True):
            group = np.asarray(group)
            # The coordinate that evens lengths belongs to the graph, not to a query's scores.
            values = v[np.searchsorted(ids, group), :-1] @ np.frombuffer(q, np.float16)[:-1].astype(np.float32)
            if len(group) > wide:
                top = np.argpartition(-values, wide - 1)[:wide]
                group, values = group[top], values[top]
            query.append(np.full(len(group), one))
            w.append(group)
            s.append(values)
        return pd.DataFrame({"query": np.concatenate(query), "w": np.concatenate(w), "s": np.concatenate(s).astype(np.float32)} if query else {"query": [], "w": [], "s": []})

    order = Window.partitionBy("query").orderBy(F.desc("s"), "w")
    for _ in range(HOPS):
        ranked = beam.withColumn("turn", F.row_number().over(Window.partitionBy("query", "expanded").orderBy(F.desc("s"), "w")))
        marked = written(ranked.withColumn("now", ~F.col("expanded") & (F.col("turn") <= wide // 2)).drop("turn"), "marked")
        met = marked.where("now").join(near, F.col("w") == F.col("centre")).select("query", F.explode("members").alias("w")).distinct()
        fresh = written(met.join(seen, ["query", "w"], "left_anti"), "fresh")
        seen = written(seen.union(fresh), "seen")
        pairs = fresh.groupBy("query", block_of("w", blocks).alias("block")).agg(F.collect_list("w").alias("ws")).join(asked, "query")
        scored = pairs.groupBy("block").cogroup(placed.groupBy("home")).applyInPandas(score, "query long, w long, s float")
        old = marked.select("query", "w", "s", (F.col("expanded") | F.col("now")).alias("expanded"))
        merged = old.union(scored.withColumn("expanded", F.lit(False)))
        beam = written(merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wide).drop("place"), "beam")
        forget(graph.sparkSession)
        if (beam.agg(F.avg((~F.col("expanded")).cast("int"))).first()[0] or 0) <= ARRIVED:
            break
    return beam.select("query", "w", "s")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row that fulfils the condition `is_query` (on vec_id), the k
    rows with the largest inner products that the graph search finds, its own excluded; nearest
    first, ties to the smaller id.

    Rows without id, and vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components, take no part, as queries or candidates. Of repeated rows with one id and vector one counts. With k
    candidates or fewer all are returned; an empty table gives none. Other columns are left out.
    """
    spark = df.sparkSession
    rows = written(usable(df, id_col, vec_col).distinct(), "vectors")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    facts = rows.agg(F.percentile_approx(length, 1 - LONGER, 10_000).alias("even"), F.max(F.size("x")).alias("d")).first()
    if facts.d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = facts.d + 1
    groups = written(rows.groupBy("x").agg(F.min("vec_id").alias("node")), "nodes")
    nodes = groups.count()
    vectors = written(packed(groups, facts.even, facts.d), "packed")
    # The smallest ids of each group of equal vectors; each task keeps its first before the shuffle.
    place = Window.partitionBy("node").orderBy("vec_id")
    owner = written(rows.join(groups, "x").select("vec_id", "node"), "owner")
    members = owner.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).select("vec_id", "node")
    asking = owner.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    starts = written(asking.select("query").distinct(), "starts")
    blocks = max(1, -(-nodes // BLOCK))
    placed = written(vectors.select("node", "v", block_of("node", blocks).alias("home")), "placed")
    graph = build(vectors, placed, blocks, nodes, dims)
    found = walk(graph, placed, starts, blocks, dims, max(BEAM, 4 * k))
    # Half precision can turn near ties: the whole beam is scored again.
    exact = (
        found.select("query", "w").join(groups.select(F.col("node").alias("query"), F.col("x").alias("qx")), "query")
        .join(groups.select(F.col("node").alias("w"), "x"), "w")
        .withColumn("score", F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))
    )
    best_ids = exact.join(members, F.col("w") == F.col("node")).select("query", "vec_id", "score")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = written(best_ids.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).drop("place"), "found")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asking.join(few, "query").where("vec_id <> query_id")
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
