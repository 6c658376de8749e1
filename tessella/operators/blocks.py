"""Bridges, articulation points and biconnected components.

A breadth-first forest is grown level by level. An edge outside the forest
joins two nodes at most one level apart; walking both ends up to where they
meet passes the tree edges of one cycle, and edges sharing a cycle share a
block. The walks go level by level too, with equal walks merged, and the
components of the "same cycle" links are the blocks.

Components of few nodes are searched depth first instead, many in a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.components import component_edges, connected_components
from tessella.operators.small import NODES, on_whole, parted
from tessella.runtime import cut, no_rows


def bfs_forest(graph: Graph) -> list[DataFrame]:
    """Per depth, (node_id, parent); the root of a component is its least node."""
    sym = cut(graph.sym().select("a", F.col("b").alias("_to")), "sym")
    roots = connected_components(graph).where("node_id = component_id")
    cur = cut(roots.select("node_id", F.col("node_id").alias("parent")), "bfs")
    levels, prev = [cur], cur.limit(0)
    while True:
        step = cur.join(sym, cur["node_id"] == sym["a"]).select(
            F.col("_to").alias("node_id"), F.col("a").alias("parent"), F.lit(0).alias("old"))
        seen = cur.unionAll(prev).select("node_id", "parent", F.lit(1).alias("old"))
        nxt = cut(
            step.unionAll(seen).groupBy("node_id").agg(F.min("parent").alias("parent"), F.max("old").alias("old"))
            .where("old = 0").select("node_id", "parent"), "bfs")
        if no_rows(nxt):
            return levels
        levels.append(nxt)
        prev, cur = cur, nxt


def _local_blocks(component: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Columns u, v, block_id of the edges of whole components."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    by = np.argsort(at, kind="stable")
    start = np.searchsorted(at[by], np.arange(len(names) + 1)).tolist()
    edge, far = (by % len(u)).tolist(), np.concatenate([at[len(u):], at[: len(u)]])[by].tolist()
    left, right = at[: len(u)].tolist(), at[len(u):].tolist()
    block, todo, met, low, clock = [0] * len(u), start[:-1], [0] * len(names), [0] * len(names), 0
    for root in range(len(names)):  # in the order of their names, so a search begins at the least of its component
        if met[root]:
            continue
        clock += 1
        met[root] = low[root] = clock
        path, via, held = [root], [-1], []
        while path:
            x, k = path[-1], todo[path[-1]]
            if k < start[x + 1]:
                todo[x] = k + 1
                e, y = edge[k], far[k]
                if e == via[-1]:
                    continue
                if not met[y]:
                    clock += 1
                    met[y] = low[y] = clock
                    path.append(y)
                    via.append(e)
                    held.append(e)
                elif met[y] < met[x]:
                    low[x] = min(low[x], met[y])
                    held.append(e)
                continue
            path.pop()
            e = via.pop()
            if not path:
                continue
            top = path[-1]
            low[top] = min(low[top], low[x])
            if low[x] >= met[top]:  # a block hangs from ``top``
                first = held.index(e)
                least = min(z for f in held[first:] for z in (left[f], right[f]) if z != top)
                for f in held[first:]:
                    block[f] = least
                del held[first:]
    return [u, v, names[block]]


def blocks(graph: Graph, small_nodes: int = NODES) -> DataFrame:
    """(u, v, block_id): the biconnected component of every edge.

    The id is the least of the block's tree edges, each named by its lower end:
    the least node but the one nearest to the least node of the component.
    Components of more than ``small_nodes`` nodes, and nodes that are not whole
    numbers, go through rounds.
    """
    near, rest = parted(graph, nodes=small_nodes)
    kind = graph.vertices.schema["node_id"].dataType.simpleString()
    local = None if near is None else on_whole(near.select("component_id", "u", "v"), _local_blocks, f"u {kind}, v {kind}, block_id {kind}")
    if rest is None:
        return local
    return _walked(rest) if local is None else local.unionAll(_walked(rest))


def _walked(graph: Graph) -> DataFrame:
    """(u, v, block_id) by walks up a breadth-first forest."""
    levels = bfs_forest(graph)
    tree = cut(reduce(DataFrame.unionAll, [l.select("node_id", "parent", F.lit(d).alias("depth")) for d, l in enumerate(levels)]), "tree")
    up = tree.select(F.col("node_id").alias("n"), F.col("parent").alias("p"), F.col("depth").alias("dn"))
    e = graph.edges.where("u <> v").select("u", "v")
    ends = e.join(up.toDF("u", "pu", "du"), "u").join(up.toDF("v", "pv", "dv"), "v")
    # hi: the deeper end (the greater id on a tie), which names the edge's block.
    swap = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") > F.col("v")))
    named = ends.select(
        "u", "v",
        F.when(swap, F.col("u")).otherwise(F.col("v")).alias("hi"), F.when(swap, F.col("v")).otherwise(F.col("u")).alias("lo"),
        F.when(swap, F.col("pu")).otherwise(F.col("pv")).alias("phi"), F.greatest("du", "dv").alias("d"), F.least("du", "dv").alias("dl"),
    )
    named = cut(named.withColumn("tree", F.col("phi") == F.col("lo")), "named")
    extra = named.where("not tree")
    links = []
    pending = None
    for d in range(len(levels) - 1, 0, -1):
        here = extra.where(F.col("d") == d)
        # Ends on one level walk as they are; of uneven ends the deeper one takes its first step.
        even = here.where("dl = d").select(F.col("lo").alias("x"), F.col("hi").alias("y"))
        uneven = here.where("dl < d").select(F.col("hi").alias("x"), F.col("phi").alias("px"), F.col("lo").alias("y"))
        same = even if pending is None else even.unionAll(pending)
        same = same.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        par = levels[d]
        walk = cut(
            same.join(par.toDF("x", "px"), "x").join(par.toDF("y", "py"), "y").select("x", "px", "y", "py"), "walk")
        apart = walk.where("px <> py")
        links += [walk.select(F.col("x").alias("u"), F.col("y").alias("v")),
                  apart.select(F.col("x").alias("u"), F.col("px").alias("v")),
                  apart.select(F.col("y").alias("u"), F.col("py").alias("v")),
                  uneven.select(F.col("x").alias("u"), F.col("px").alias("v")),
                  uneven.select(F.col("x").alias("u"), F.col("y").alias("v"))]
        pending = apart.select(F.col("px").alias("x"), F.col("py").alias("y")).unionAll(uneven.select(F.col("px").alias("x"), "y"))
    if links:
        stars = component_edges(reduce(DataFrame.unionAll, links))
        label = stars.select(F.col("v").alias("hi"), F.col("u").alias("b"))
        named = named.join(label, "hi", "left")
    else:
        named = named.withColumn("b", F.col("hi"))
    return named.select("u", "v", F.coalesce("b", "hi").alias("block_id"))


def bridges(graph: Graph, blocked: DataFrame | None = None) -> DataFrame:
    """(u, v): edges that are a block of their own."""
    b = blocked if blocked is not None else cut(blocks(graph), "blocks")
    single = b.groupBy("block_id").agg(F.count("*").alias("n"), F.min("u").alias("u"), F.min("v").alias("v")).where("n = 1")
    return single.select("u", "v")


def articulation_points(graph: Graph, blocked: DataFrame | None = None) -> DataFrame:
    """(node_id, articulation_point): 1 for nodes that lie in two or more blocks."""
    b = blocked if blocked is not None else cut(blocks(graph), "blocks")
    ends = b.select(F.explode(F.array("u", "v")).alias("node_id"), "block_id")
    per = ends.groupBy("node_id").agg((F.min("block_id") != F.max("block_id")).cast("int").alias("f"))
    return graph.vertices.select("node_id").join(per, "node_id", "left").select(
        "node_id", F.coalesce("f", F.lit(0)).alias("articulation_point"))


def biconnected_components(graph: Graph, blocked: DataFrame | None = None) -> DataFrame:
    """(block_id, node_id) in long form."""
    b = blocked if blocked is not None else cut(blocks(graph), "blocks")
    return b.select("block_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
