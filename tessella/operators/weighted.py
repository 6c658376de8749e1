"""Weighted shortest paths by delta-stepping, all sources side by side.

A row (src, node_id, d, open) says that ``src`` reaches a node at length ``d``;
it is open while its neighbours have not been told. Lengths fall into buckets of
width ``delta``. In a round every source relaxes the open nodes of its own least
open bucket, so a source with short paths does not wait for one with long ones.
Weights are not negative, so nothing below a source's least open bucket changes
any more: a round is one join with the edges and one minimum per (src, node),
and there are at most as many rounds as the longest bucket sequence of a source
times the steps inside a bucket.

A mean over components of few nodes is taken on arrays of all their pairs instead.

Lengths use the absolute weight. An edge whose weight is null or NaN cannot be
travelled; of repeated edges the shortest counts; self-loops do not matter. A
source that is not a node of the graph reaches itself only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph, symmetric
from tessella.operators.components import connected_components
from tessella.operators.small import NODES, gathered, on_whole, parted, stacks
from tessella.runtime import cut, no_rows

# (source, node) rows worked on at a time; more sources are done in batches.
STATE_ROWS = 2_000_000_000


def _lengths(graph: Graph, weight: str) -> DataFrame:
    """Edges (u, v, w) that can be travelled."""
    w = F.abs(F.col(weight).cast("double"))
    edges = graph.edges.where(F.col("u") != F.col("v")).select("u", "v", w.alias("w")).where("w is not null and not isnan(w)")
    return edges.groupBy("u", "v").agg(F.min("w").alias("w"))


def _arcs(graph: Graph, weight: str) -> DataFrame:
    """(a, b, w) in both directions."""
    return cut(symmetric(_lengths(graph, weight)), "arcs")


def _width(arcs: DataFrame, delta: float | None) -> float:
    if delta is not None:
        if not delta > 0:
            raise ValueError("delta must be positive")
        return float(delta)
    mean = arcs.agg(F.avg("w")).first()[0]
    return mean if mean else 1.0


def _search(start: DataFrame, arcs: DataFrame, delta: float) -> DataFrame:
    """(src, node_id, d) of everything the sources ``start(node_id)`` reach."""
    s = F.col("node_id")
    state = cut(start.select(s.alias("src"), s, F.lit(0.0).alias("d"), F.lit(True).alias("open")), "paths")
    bucket = F.floor(F.col("d") / F.lit(delta))
    while not no_rows(state.where("open")):
        least = state.where("open").groupBy(F.col("src").alias("_src")).agg(F.min(bucket).alias("_least"))
        marked = state.join(least, F.col("src") == F.col("_src"), "left").withColumn("_now", F.col("open") & (bucket == F.col("_least")))
        told = marked.where("_now").join(arcs, F.col("node_id") == F.col("a")).select(
            "src", F.col("b").alias("node_id"), (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old"), F.lit(False).alias("open")
        )
        known = marked.select("src", "node_id", "d", F.col("d").alias("old"), F.coalesce(F.col("open") & ~F.col("_now"), F.lit(False)).alias("open"))
        best = told.unionByName(known).groupBy("src", "node_id").agg(F.min("d").alias("d"), F.min("old").alias("old"), F.max("open").alias("open"))
        shorter = F.col("old").isNull() | (F.col("d") < F.col("old"))
        state = cut(best.select("src", "node_id", "d", (F.col("open") | shorter).alias("open")), "paths")
    return state.select("src", "node_id", "d")


def weighted_distances(graph: Graph, sources: DataFrame, weight: str = "weight", delta: float | None = None) -> DataFrame:
    """(src, node_id, d): shortest length from every row of ``sources(node_id)`` to each node it reaches, itself at 0."""
    arcs = _arcs(graph, weight)
    return _search(sources.select("node_id").distinct(), arcs, _width(arcs, delta))


def _local_means(component: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Columns node, minus its mean length to the others, of whole components."""
    out = []
    for nodes, c, i, j, rows in stacks(component, u, v):
        k, n = nodes.shape
        d = np.full((k, n, n), np.inf)
        d[:, np.arange(n), np.arange(n)] = 0.0
        np.minimum.at(d, (c, i, j), w[rows])
        np.minimum.at(d, (c, j, i), w[rows])
        for m in range(n):
            np.minimum(d, d[:, :, m, None] + d[:, None, m, :], out=d)
        # the nodes of a component reach each other, be it at infinite length
        out.append((nodes, -d.sum(axis=2) / (n - 1)))
    return gathered(out, [u.dtype, float])


def mean_weighted_distance(graph: Graph, weight: str = "weight", delta: float | None = None, batches: int | None = None, small_nodes: int = NODES) -> DataFrame:
    """(node_id, avg_w_shortest_path_length): minus the mean length to the other nodes a node reaches, 0 if there are none.

    Components of more than ``small_nodes`` nodes, and nodes that are not whole numbers, are
    searched by rounds. Their sources are done in ``batches``, by default as many as keep the
    (source, node) rows of a batch near STATE_ROWS; what a batch leaves is a row per source.
    """
    nodes = graph.vertices.select("node_id")
    near, rest = parted(Graph(nodes, cut(_lengths(graph, weight), "lengths")), nodes=small_nodes)
    kind = nodes.schema["node_id"].dataType.simpleString()
    per = None if near is None else on_whole(near, _local_means, f"node_id {kind}, m double")
    if rest is not None:
        arcs = cut(symmetric(rest.edges), "arcs")
        width = _width(arcs, delta)
        if batches is None:
            sizes = connected_components(rest).groupBy("component_id").agg(F.count("*").cast("double").alias("n"))
            batches = max(1, int(-(-(sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) // STATE_ROWS)))
        for i in range(batches):
            paths = _search(rest.vertices.where(F.pmod(F.xxhash64("node_id"), F.lit(batches)) == i), arcs, width)
            means = cut(paths.where("src <> node_id").groupBy(F.col("src").alias("node_id")).agg((-F.avg("d")).alias("m")), "means")
            per = means if per is None else per.unionAll(means)
    return nodes.join(per, "node_id", "left").select("node_id", (F.coalesce("m", F.lit(0.0)) + 0.0).alias("avg_w_shortest_path_length"))
