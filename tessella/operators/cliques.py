"""Maximal-clique centrality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.local import edge_triangles, triangle_list
from tessella.operators.small import on_whole
from tessella.runtime import cut


def _maximal_sets(near: dict) -> list[list]:
    """Maximal cliques of a small graph given as neighbour sets, with a pivot."""
    out, stack = [], [([], set(near), set())]
    while stack:
        held, cand, used = stack.pop()
        if not cand and not used:
            out.append(held)
            continue
        pivot = max(cand | used, key=lambda n: len(near[n] & cand))
        for n in list(cand - near[pivot]):
            stack.append((held + [n], cand & near[n], used & near[n]))
            cand.remove(n)
            used.add(n)
    return out


def _at_centres(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[pa.Array]:
    """Columns a, rest: maximal cliques of the links (b, c) at every centre, centres one after the other."""
    ends = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    left, right, at, found = b.tolist(), c.tolist(), [], []
    for i, j in zip(ends, ends[1:]):
        if j - i == 1:
            sets = [[left[i], right[i]]]
        else:
            near: dict = {}
            for x, y in zip(left[i:j], right[i:j]):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
            sets = _maximal_sets(near)
        found += [sorted(s) for s in sets]
        at += [i] * len(sets)
    return [pa.array(a[at]), pa.array(found, pa.list_(pa.array(b).type))]


def maximal_cliques(graph: Graph) -> DataFrame:
    """(members array) of every maximal clique of two or more nodes.

    A clique is looked for at its member of least (degree, id) only, inside the
    at most sqrt(2 E) later neighbours of that node; whether an earlier node
    extends it is settled by a join with the triangles.
    """
    tri = cut(triangle_list(graph), "triangles")
    kind = graph.vertices.schema["node_id"].dataType.simpleString()

    local = cut(on_whole(tri.select("a", "b", "c"), _at_centres, f"a {kind}, rest array<{kind}>"), "cliques")
    pair = local.select("a", "rest", F.explode("rest").alias("p")).select("a", "rest", F.least("a", "p").alias("x"), F.greatest("a", "p").alias("y"))
    above = tri.select(F.col("a").alias("z"), F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"))
    covered = pair.join(above, ["x", "y"]).groupBy("a", "rest", "z").agg(F.count("*").alias("n")).where(F.col("n") == F.size("rest")).select("a", "rest").distinct()
    large = local.join(covered, ["a", "rest"], "left_anti").select(F.array_sort(F.concat(F.array("a"), F.col("rest"))).alias("members"))
    two = edge_triangles(graph, tri).where("common = 0").select(F.array("u", "v").alias("members"))
    return large.unionAll(two)


def maximal_clique_centrality(graph: Graph, normalize: bool = True) -> DataFrame:
    """(node_id, mcc): sum of (size - 1)! over the node's maximal cliques.

    A node whose neighbours share no edge scores its degree, which the same sum
    gives (a clique of two counts 1). Normalised by the largest clique's value.
    """
    q = cut(maximal_cliques(graph), "cliques")
    top = q.agg(F.max(F.size("members"))).first()[0] or 1
    # (size - 1)! / (top - 1)! as one product, so that no factorial overflows; without the scale, a clique of over 171 nodes does.
    first = (F.size("members") if normalize else F.lit(1)).cast("int")
    last = F.lit(top - 1) if normalize else F.size("members") - 1
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    fact = F.aggregate(steps, F.lit(1.0), (lambda s, k: s / k) if normalize else (lambda s, k: s * k))
    per = q.select(F.explode("members").alias("node_id"), fact.alias("f")).groupBy("node_id").agg(F.sum("f").alias("s"))
    return graph.vertices.select("node_id").join(per, "node_id", "left").select("node_id", F.coalesce("s", F.lit(0.0)).alias("mcc"))
