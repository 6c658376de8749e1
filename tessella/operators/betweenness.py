"""Node and edge betweenness by level-synchronous dependency accumulation.

Components of few nodes run the same levels on arrays, from all their nodes at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.small import NODES, gathered, on_whole, parted, stacks
from tessella.runtime import cut, no_rows


def _pass(sources: DataFrame, arcs: DataFrame) -> list[DataFrame]:
    """Per edge direction (v, w) on shortest paths: summed dependency, all and without v as source."""
    start = sources.select(F.col("node_id").alias("src"), "node_id", F.lit(1.0).alias("sigma"))
    levels, prev, cur = [cut(start, "bc")], start.limit(0), None
    cur = levels[0]
    while True:
        step = cur.join(arcs, cur["node_id"] == arcs["a"]).select(
            "src", F.col("_to").alias("node_id"), F.col("sigma").alias("s"), F.lit(0).alias("old")
        )
        seen = cur.unionAll(prev).select("src", "node_id", F.lit(0.0).alias("s"), F.lit(1).alias("old"))
        nxt = (
            step.unionAll(seen).groupBy("src", "node_id").agg(F.sum("s").alias("sigma"), F.max("old").alias("old"))
            .where("old = 0").select("src", "node_id", "sigma")
        )
        nxt = cut(nxt, "bc")
        if no_rows(nxt):
            break
        levels.append(nxt)
        prev, cur = cur, nxt
    flows = []
    below = levels[-1].withColumn("delta", F.lit(0.0)) if len(levels) > 1 else None
    for level in reversed(levels[:-1]):
        lower = below.select("src", F.col("node_id").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        back = lower.join(arcs, lower["w"] == arcs["a"]).select("src", "w", F.col("_to").alias("node_id"), "share")
        dep = cut(
            level.join(back, ["src", "node_id"]).select("src", F.col("node_id").alias("v"), "w", "sigma", (F.col("sigma") * F.col("share")).alias("c")),
            "dep",
        )
        inner = F.when(F.col("src") != F.col("v"), F.col("c")).otherwise(0.0)
        flows.append(dep.groupBy("v", "w").agg(F.sum("c").alias("c"), F.sum(inner).alias("ci")))
        got = dep.groupBy("src", F.col("v").alias("node_id")).agg(F.sum("c").alias("delta"))
        below = cut(
            level.join(got, ["src", "node_id"], "left").select("src", "node_id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")),
            "bc",
        )
    return flows


def _local_pass(component: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Columns v, w, c, ci of whole components, with all nodes as sources."""
    out = []
    for nodes, c, i, j, _ in stacks(component, u, v):
        k, n = nodes.shape
        near = np.zeros((k, n, n))
        np.add.at(near, (c, i, j), 1.0)
        np.add.at(near, (c, j, i), 1.0)
        # rows are sources; a level holds the path counts of the nodes first reached on it
        cur = np.broadcast_to(np.eye(n), (k, n, n))
        unseen, levels = cur == 0, []
        while cur.any():
            levels.append(cur)
            cur = np.matmul(cur, near) * unseen
            unseen = unseen & (cur == 0)
        delta, every, inner = np.zeros((k, n, n)), np.zeros((k, n, n)), np.zeros((k, n, n))
        for d in range(len(levels) - 1, 0, -1):
            share = np.divide(1.0 + delta, levels[d], out=np.zeros((k, n, n)), where=levels[d] > 0)
            flow = np.matmul(levels[d - 1].transpose(0, 2, 1), share) * near
            every += flow
            if d > 1:
                inner += flow
            delta = levels[d - 1] * np.matmul(share, near)
        at = np.nonzero(near)
        out.append((nodes[at[0], at[1]], nodes[at[0], at[2]], every[at], inner[at]))
    return gathered(out, [u.dtype, u.dtype, float, float])


def dependencies(graph: Graph, pivots: int | None = None, seed: int = 42, batches: int = 1, small_nodes: int = NODES) -> DataFrame:
    """(v, w, c, ci) summed over sources.

    ``pivots`` keeps that many sources, picked by a seeded hash, instead of all;
    ``batches`` works through the sources in turns to bound the state. Components
    of at most ``small_nodes`` nodes need no turns.
    """
    flows: list[DataFrame] = []
    if pivots is None:
        near, rest = parted(graph, nodes=small_nodes)
        if near is not None:
            kind = near.schema["u"].dataType.simpleString()
            flows.append(on_whole(near.select("component_id", "u", "v"), _local_pass, f"v {kind}, w {kind}, c double, ci double"))
        if rest is None:
            return cut(flows[0], "dep")
        graph = rest
    nodes = graph.vertices.select("node_id")
    if pivots is not None:
        nodes = cut(nodes.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(pivots), "pivots")
    arcs = cut(graph.sym().select("a", F.col("b").alias("_to")), "sym")
    for i in range(batches):
        part = nodes.where(F.pmod(F.xxhash64("node_id"), F.lit(batches)) == i) if batches > 1 else nodes
        flows += _pass(part, arcs)
    if not flows:
        return arcs.select(F.col("a").alias("v"), F.col("_to").alias("w"), F.lit(0.0).alias("c"), F.lit(0.0).alias("ci")).limit(0)
    return cut(reduce(DataFrame.unionAll, flows).groupBy("v", "w").agg(F.sum("c").alias("c"), F.sum("ci").alias("ci")), "dep")


def _factor(graph: Graph, pivots: int | None) -> float:
    """Each pair is met from both ends; sampled sources are scaled up to all."""
    return 0.5 if pivots is None else 0.5 * graph.vertices.count() / pivots


def betweenness(graph: Graph, pivots: int | None = None, seed: int = 42, deps: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """(node_id, betweenness), not normalised."""
    d = deps if deps is not None else dependencies(graph, pivots, seed, batches)
    per = d.groupBy(F.col("v").alias("node_id")).agg((F.sum("ci") * _factor(graph, pivots)).alias("b"))
    return graph.vertices.select("node_id").join(per, "node_id", "left").select("node_id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def edge_betweenness(graph: Graph, pivots: int | None = None, seed: int = 42, deps: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """(u, v, edge_betweenness), not normalised."""
    d = deps if deps is not None else dependencies(graph, pivots, seed, batches)
    per = d.groupBy(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).agg((F.sum("c") * _factor(graph, pivots)).alias("b"))
    return graph.edges.where("u <> v").select("u", "v").join(per, ["u", "v"], "left").select(
        "u", "v", F.coalesce("b", F.lit(0.0)).alias("edge_betweenness")
    )
