"""Connected components: stretches of edges are contracted first, then large-star and small-star rounds alternate.

Edges are dealt by range and every task joins what meets within a bounded stretch
of them. Only the least nodes of such stretches that share a node go through the
rounds, so rounds read little where near ids tend to be linked, and no more than
the edges where they are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph, canonical, symmetric
from tessella.runtime import cut, no_rows, ship

# Edges joined at once in a task.
STRETCH = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the least of its neighbourhood."""
    s = symmetric(edges)
    least = s.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # Repeats are left in: the small-star that follows removes them in its own shuffle.
    return s.where("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them (u < v on input)."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(F.col("m").alias("u"), F.col("v"))
    return moved.unionAll(own).where("u < v").distinct()


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the least node it is linked to."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root): for every stretch of ``edges(u, v)``, its nodes with the least node each is linked to."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in held]).combine_chunks().dictionary_encode()
            order = pc.array_sort_indices(ends.dictionary).to_numpy()
            names, place = ends.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = place[ends.indices.to_numpy()]
            half = len(at) // 2
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(_roots(at[:half], at[half:], len(names))))], ["node", "root"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= STRETCH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    ship(edges.sparkSession)
    placed = edges.select("u", "v").repartitionByRange("u", "v").sortWithinPartitions("u", "v")
    return placed.mapInArrow(run, f"node {kind}, root {kind}")


def component_edges(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Star edges (u = least node of the component, v) of a graph."""
    e = canonical(edges)
    if e.schema["u"].dataType.simpleString() not in ("bigint", "int", "string"):
        return _star_rounds(cut(e, "cc"), max_rounds)
    # A node is in as many sets as there are stretches at most.
    sets = cut(_joined(cut(e, "cc")).groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", F.array_min("roots").alias("root"), "roots"), "joined")
    links = sets.where(F.size("roots") > 1).select(F.col("root").alias("u"), F.explode("roots").alias("v"))
    found = sets.select("node", "root")
    links = cut(canonical(links), "cc")
    if not no_rows(links):
        far = _star_rounds(links, max_rounds).select(F.col("u").alias("_far"), F.col("v").alias("root"))
        found = found.join(far, "root", "left").select("node", F.coalesce("_far", "root").alias("root"))
    return cut(found.where("root <> node").select(F.col("root").alias("u"), F.col("node").alias("v")), "cc")


def _star_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    cur, seen = edges, None
    for _ in range(max_rounds):
        nxt = cut(_small_star(_large_star(cur)), "cc")
        # The star forest is reached when no centre is itself a leaf. Comparing
        # order-free fingerprints of two rounds avoids a join.
        mark = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if mark == seen:
            return nxt
        seen, cur = mark, nxt
    raise RuntimeError("components did not settle; raise max_rounds")


def connected_components(graph: Graph) -> DataFrame:
    """(node_id, component_id): the id is the least node of the component."""
    stars = component_edges(graph.edges)
    return graph.vertices.select("node_id").join(
        stars.select(F.col("v").alias("node_id"), F.col("u").alias("component_id")), "node_id", "left"
    ).select("node_id", F.coalesce("component_id", "node_id").alias("component_id"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component_id").agg(F.count("*").alias("n_nodes"))


def components_within(components: DataFrame, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """Rows of components whose node count lies in [min_size, max_size]."""
    keep = component_sizes(components).where(F.col("n_nodes") >= min_size)
    if max_size is not None:
        keep = keep.where(F.col("n_nodes") <= max_size)
    return components.join(keep, "component_id")
