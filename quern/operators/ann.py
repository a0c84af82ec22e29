"""Sharded graphs over a table's vectors: build, search, reports.

Rows are dealt into shards by their id; each shard is a graph of its own, built
by one task and kept as Parquet rows.  A search asks every shard for candidates
and, where it is to be exact, checks all of the shard's vectors against the bound
that they give.  When rows change, the new vectors make
another layer of shards and the nodes of the old ones are marked dead; they still
lead to others until the whole is built anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.hnsw import Hnsw, Params

#: Vectors of a shard: at most, and at least where there are fewer shards than cores.
SHARD_ROWS, LEAST_ROWS = 5_000, 1_000
LEAK_THRESHOLD = 0.10
#: Layers of a graph; the change after that builds it anew.
MAX_LAYERS = 8
_DEAD = "layer int, shard int, node int"
_NODES = "shard int, node int, tid long, neighbours array<array<int>>, v array<float>, entry boolean"


@dataclass(frozen=True)
class Graph:
    """Folders of the layers, oldest first, and that of the dead nodes."""

    layers: tuple[str, ...]
    dead: str | None = None


def _graph(graph: str | Graph) -> Graph:
    return Graph((graph,)) if isinstance(graph, str) else graph


def _nodes(spark: SparkSession, graph: Graph) -> DataFrame:
    layers = [spark.read.parquet(path).withColumn("layer", F.lit(i)) for i, path in enumerate(graph.layers)]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def _dead(spark: SparkSession, graph: Graph) -> DataFrame:
    return spark.read.schema(_DEAD).parquet(graph.dead) if graph.dead else spark.createDataFrame([], _DEAD)


def _by_shard(spark: SparkSession, graph: Graph, metric: str, params: Params, give, kind: str) -> DataFrame:
    """What ``give(graph, ids)`` makes of every shard, whose dead nodes are marked."""
    groups = _nodes(spark, graph).groupBy("layer", "shard")
    if graph.dead is None:
        return groups.applyInPandas(lambda part: give(*load_shard(part, metric, params)), kind)

    def marked(part: pd.DataFrame, dead: pd.DataFrame) -> pd.DataFrame:
        shard, tids = load_shard(part, metric, params)
        shard.dead = set(dead.node.tolist())
        return give(shard, tids)

    return groups.cogroup(_dead(spark, graph).groupBy("layer", "shard")).applyInPandas(marked, kind)


def extend(graph: Graph, removed: DataFrame, added: DataFrame, tid: str, vector: str, metric: str, path: str) -> Graph | None:
    """The graph after the rows ``removed`` gave way to ``added``; None if it should be built anew.

    Rows that are in both cost nothing.  It is built anew when more than
    LEAK_THRESHOLD of its nodes would be dead, or when it has MAX_LAYERS layers.
    """
    spark = added.sparkSession
    old, new = (rows.where(F.col(vector).isNotNull()).select(F.col(tid).alias("tid"), F.col(vector).alias("v")) for rows in (removed, added))
    fresh, gone = new.join(old, ["tid", "v"], "left_anti"), old.join(new, ["tid", "v"], "left_anti").select("tid")
    layers, dead = graph.layers, graph.dead
    if not gone.isEmpty():
        was = _dead(spark, graph)
        live = _nodes(spark, graph).select("layer", "shard", "node", "tid").join(was, ["layer", "shard", "node"], "left_anti")
        dead = f"{path}/dead"
        was.unionByName(live.join(gone, "tid", "left_semi").drop("tid")).write.mode("overwrite").parquet(dead)
        if spark.read.schema(_DEAD).parquet(dead).count() > LEAK_THRESHOLD * _nodes(spark, graph).count():
            return None
    if not fresh.isEmpty():
        if len(layers) >= MAX_LAYERS:
            return None
        build(fresh, "tid", "v", metric, f"{path}/layer")
        layers = (*layers, f"{path}/layer")
    return Graph(layers, dead)


def build(rows: DataFrame, tid: str, vector: str, metric: str, path: str, params: Params = Params()) -> None:
    """Write the graphs of all rows with a vector to ``path``; null vectors have no node."""
    found = rows.where(F.col(vector).isNotNull()).select(F.col(tid).alias("tid"), F.col(vector).alias("v"))
    n, cores = found.count(), found.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD_ROWS), min(cores, n // LEAST_ROWS))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("tid"), F.lit(shards)).cast("int"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tid")
        graph = Hnsw(metric, params)
        graph.fill(part.v)
        return pd.DataFrame(
            {
                "shard": part.shard.to_numpy(),
                "node": np.arange(len(part), dtype=np.int32),
                "tid": part.tid.to_numpy(),
                "neighbours": graph.neighbours,
                "v": part.v.to_numpy(),
                "entry": np.arange(len(part)) == graph.entry,
            }
        )

    dealt.groupBy("shard").applyInPandas(one, _NODES).write.mode("overwrite").parquet(path)


def load_shard(part: pd.DataFrame, metric: str, params: Params = Params()) -> tuple[Hnsw, np.ndarray]:
    """The graph of a shard's rows, and the ids of its nodes."""
    part = part.sort_values("node")
    graph = Hnsw(metric, params)
    graph.vectors = np.stack(part.v.to_numpy()).astype(np.float64)
    graph.norms = np.sqrt((graph.vectors**2).sum(1))
    graph.neighbours = [[list(map(int, layer)) for layer in node] for node in part.neighbours]
    graph._n = len(part)
    graph.entry = int(part.node[part.entry].iloc[0])
    return graph, part.tid.to_numpy()


def search(
    spark: SparkSession, graph: str | Graph, metric: str, queries: list[list[float]], k: int, ef: int | None = None, params: Params = Params(),
    ties: float | None = None,
) -> DataFrame:
    """(query, tid, distance): live candidates of every shard, at most max(2k, ef) each; L2 is the square root here.

    With ``ties`` they are exactly the k nearest of every shard, and all rows that are
    farther than its k-th by that at most.
    """
    ef = max(params.ef_search if ef is None else ef, 2 * k, 1)
    shared = spark.sparkContext.broadcast([list(map(float, q)) for q in queries])  # as large as the caller's list

    def one(graph: Hnsw, tids: np.ndarray) -> pd.DataFrame:
        if ties is not None:
            out = [(i, int(tids[n]), d) for i, q in enumerate(shared.value) for n, d in graph.within(q, k, ties, ef)]
            return pd.DataFrame(out, columns=["query", "tid", "distance"])
        take = min(max(2 * k, ef), len(graph))
        out = [(i, int(tids[n]), math.sqrt(max(0.0, d)) if metric == "vector_l2_ops" else d)
               for i, q in enumerate(shared.value) for n, d in graph.search(q, take, max(ef, take))]
        return pd.DataFrame(out, columns=["query", "tid", "distance"])

    return _by_shard(spark, _graph(graph), metric, params, one, "query int, tid long, distance double")


def report(spark: SparkSession, graph: str | Graph, live: DataFrame, metric: str, tid: str = "_tid", threshold: float = LEAK_THRESHOLD) -> dict:
    """Nodes, nodes that are dead or whose row is gone, their share, whether to rebuild, and live nodes that can't be reached."""
    graph = _graph(graph)
    nodes = _nodes(spark, graph).select("layer", "shard", "node", "tid")
    known = nodes.join(_dead(spark, graph), ["layer", "shard", "node"], "left_anti")
    n, n_live = nodes.count(), known.join(live.select(F.col(tid).alias("tid")), "tid", "left_semi").count()

    def audit(graph: Hnsw, tids: np.ndarray) -> pd.DataFrame:
        a = graph.audit()
        return pd.DataFrame({"unreachable": [int(a["unreachable_live_count"])], "asymmetry": [a["asymmetry"]], "n": [len(tids)]})

    shards = _by_shard(spark, graph, metric, Params(), audit, "unreachable long, asymmetry double, n long")
    s = shards.agg(F.sum("unreachable").alias("u"), (F.sum(F.col("asymmetry") * F.col("n")) / F.sum("n")).alias("a")).first()
    ratio = (n - n_live) / n if n else 0.0
    return {
        "node_count": n, "live_count": n_live, "tombstoned_count": n - n_live, "leak_ratio": ratio,
        "rebuild_recommended": ratio > threshold, "unreachable_live_count": s.u or 0, "asymmetry": s.a or 0.0,
    }


def recall_at_k(truth: list[list[int]], found: list[list[int]], k: int, base: int) -> float:
    """Mean share of the k true neighbours among the first k found; input that can't be right is refused."""
    if k < 1 or not truth or len(truth) != len(found):
        raise ValueError("recall needs k of 1 or more, and as many results as true rows, at least one")
    hits = 0
    for i, rows in enumerate(zip(truth, found)):
        for what, row in zip(("true", "found"), rows):
            head = row[:k]
            if len(head) < k or len(set(head)) < k or not all(0 <= x < base for x in head):
                raise ValueError(f"query {i}: the {what} row is short, repeats an id, or has one outside 0 to {base - 1}")
        hits += len(set(rows[0][:k]) & set(rows[1][:k]))
    return hits / (len(truth) * k)


def recall_frame(truth: DataFrame, found: DataFrame, k: int, query: str = "query", item: str = "tid") -> DataFrame:
    """One row with the mean recall over all queries of two tables (query, item)."""
    a = truth.groupBy(query).agg(F.collect_set(item).alias("t"))
    b = found.groupBy(query).agg(F.collect_set(item).alias("f"))
    both = a.join(b, query, "left").select((F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<long>")))) / k).alias("r"))
    return both.agg(F.avg("r").alias("recall"))
