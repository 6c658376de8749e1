"""Markov clustering on a coordinate matrix (row, col, val), columns summing to one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph, symmetric
from tessella.operators.components import component_edges
from tessella.operators.small import NODES, apart, gathered, on_whole, stacks
from tessella.runtime import cut, no_rows

# A component whose squared change is no greater stands still: a billion of them stay far below any tolerance.
STILL = 1e-30


@dataclass(frozen=True)
class MarkovClusters:
    matrix: DataFrame    # row, col, val
    clusters: DataFrame  # cluster_id, node_id
    info: DataFrame      # cluster_id, node_id, attractor, stability
    edges: DataFrame     # cluster_id, src, dst, weight


def _column_stochastic(m: DataFrame) -> DataFrame:
    sums = m.groupBy("col").agg(F.sum("val").alias("_s"))
    return m.join(sums, "col").select("row", "col", F.when(F.col("_s") == 0, F.col("val")).otherwise(F.col("val") / F.col("_s")).alias("val"))


def start_matrix(graph: Graph, weight: str | None = None, self_loops: bool = True) -> DataFrame:
    """Column-stochastic adjacency, abs of weights, plus the identity."""
    e = graph.edges.select("u", "v", (F.abs(F.col(weight).cast("double")) if weight else F.lit(1.0)).alias("w")).where("w <> 0")
    off = symmetric(e.where("u <> v")).select(F.col("a").alias("row"), F.col("b").alias("col"), F.col("w").alias("val"))
    m = off.unionAll(e.where("u = v").select(F.col("u").alias("row"), F.col("v").alias("col"), F.col("w").alias("val")))
    if self_loops:
        m = m.unionAll(graph.vertices.select(F.col("node_id").alias("row"), F.col("node_id").alias("col"), F.lit(1.0).alias("val")))
        m = m.groupBy("row", "col").agg(F.sum("val").alias("val"))
    return _column_stochastic(m)


def _uniform_limit(graph: Graph, prune: float, self_loops: bool) -> DataFrame:
    """The limit for an unweighted loop-free graph under element-wise powers.

    All entries of a column are equal and stay equal: a column either keeps
    1/k on its k entries or, when that is below the threshold, loses them all.
    """
    own = 1 if self_loops else 0
    near = graph.sym().select(F.col("a").alias("row"), F.col("b").alias("col"))
    if self_loops:
        near = near.unionAll(graph.vertices.select(F.col("node_id").alias("row"), F.col("node_id").alias("col")))
    share = graph.degrees().where(F.col("deg") + own > 0).select(F.col("node_id").alias("col"), (F.lit(1.0) / (F.col("deg") + own)).alias("val"))
    return near.join(share.where(F.col("val") >= prune) if prune > 0 else share, "col").select("row", "col", "val")


def _power_round(m: DataFrame, times: int, inflation: float, prune: float) -> DataFrame:
    """The matrix after an expansion by ``times`` products, inflation and pruning."""
    x = m
    for _ in range(times):
        right = m.select(F.col("row").alias("_k"), F.col("col").alias("_c"), F.col("val").alias("_v"))
        x = x.join(right, x["col"] == F.col("_k")).groupBy("row", F.col("_c").alias("col")).agg(F.sum(F.col("val") * F.col("_v")).alias("val"))
    x = _column_stochastic(x.withColumn("val", F.pow("val", F.lit(float(inflation)))))
    return x.where(F.col("val") >= prune) if prune > 0 else x


def _moved(new: DataFrame, old: DataFrame) -> float:
    """Sum of the squared changes of all entries."""
    both = new.unionAll(old.select("row", "col", (-F.col("val")).alias("val"))).groupBy("row", "col").agg(F.sum("val").alias("d"))
    return both.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0


def _small_rounds(component: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, times: int, inflation: float, prune: float, rounds: int, matrix: bool) -> list:
    """Columns round, moved (the squared changes of all components in it) or, with ``matrix``, the entries after ``rounds`` rounds."""
    moved, entries = np.zeros(rounds), []
    for names, k, i, j, at in stacks(component, row, col):
        m = np.zeros((*names.shape, names.shape[1]))
        np.add.at(m, (k, i, j), val[at])
        live = np.arange(len(m))
        for t in range(rounds):
            old = m[live]
            x = old
            for _ in range(times):
                x = x @ old
            x = x**inflation
            total = x.sum(axis=1, keepdims=True)
            x = np.divide(x, total, out=x, where=total != 0)
            x[x < prune] = 0.0
            d = ((x - old) ** 2).sum(axis=(1, 2))
            m[live] = x
            moved[t] += d.sum()
            live = live[d > STILL]
            if not len(live):
                break
        if matrix:
            k, i, j = np.nonzero(m)
            entries.append((names[k, i], names[k, j], m[k, i, j]))
    return gathered(entries, [row.dtype, row.dtype, float]) if matrix else [np.arange(rounds), moved]


def markov_matrix(graph: Graph, expansion: int = 3, inflation: float = 5.0, prune: float = 0.13, tol: float = 1e-6,
                  max_iter: int = 1000, weight: str | None = None, self_loops: bool = True, matrix_power: bool | None = None,
                  small: int = NODES) -> DataFrame:
    """The settled matrix.

    Expansion is the matrix square when it is 2 and an element-wise power
    otherwise; ``matrix_power=True`` multiplies for any whole expansion. Products
    stay within components: those of at most ``small`` nodes are multiplied on
    arrays, and the rounds end for all where the changes of all together settle.
    """
    multiply = expansion == 2 if matrix_power is None else matrix_power
    if not multiply and weight is None and no_rows(graph.edges.where("u = v")):
        return cut(_uniform_limit(graph, prune, self_loops), "mcl")
    m = start_matrix(graph, weight, self_loops)
    if multiply:
        near, m = apart(m, graph, "row", small)
        return _products(near, m, expansion - 1, inflation, prune, tol, max_iter)
    m = cut(m, "mcl")
    for _ in range(max_iter):
        x = _column_stochastic(m.withColumn("val", F.pow(F.pow("val", F.lit(float(expansion))), F.lit(float(inflation)))))
        # After pruning a column keeps at most 1/prune entries, which bounds the next product.
        x = cut(x.where(F.col("val") >= prune) if prune > 0 else x, "mcl")
        moved, m = _moved(x, m) ** 0.5, x
        if moved < tol:
            return m
    raise RuntimeError("the matrix has not settled; raise max_iter")


def _products(near: DataFrame | None, far: DataFrame | None, times: int, inflation: float, prune: float, tol: float, max_iter: int) -> DataFrame:
    """The settled matrix of small components ``near(component_id, row, col, val)`` and of all others."""
    moved = {}
    if near is not None:
        small = lambda rounds, matrix, schema: on_whole(near, lambda *cols: _small_rounds(*cols, times, inflation, prune, rounds, matrix), schema)
        by_round = small(max_iter, False, "round long, moved double").where("moved > 0").groupBy("round").agg(F.sum("moved").alias("moved"))
        moved = {r["round"]: r["moved"] for r in by_round.collect()}  # a row for each round
    for t in range(max_iter):
        change = moved.get(t, 0.0)
        if far is not None:
            # After pruning a column keeps at most 1/prune entries, which bounds the next product.
            x = cut(_power_round(far, times, inflation, prune), "mcl")
            change, far = change + _moved(x, far), x
        if change**0.5 < tol:
            break
    else:
        raise RuntimeError("the matrix has not settled; raise max_iter")
    if near is None:
        return far
    kind = near.schema["row"].dataType.simpleString()
    settled = small(t + 1, True, f"row {kind}, col {kind}, val double")
    return cut(settled if far is None else settled.unionByName(far.select("row", "col", "val")), "mcl")


def markov_clusters(graph: Graph, min_cluster_size: int = 2, singletons: bool = True, **params) -> MarkovClusters:
    """Clusters are the components of the settled matrix; the id is the least node."""
    m = markov_matrix(graph, **params)
    stars = component_edges(m.where("row <> col and val > 0").select(F.col("row").alias("u"), F.col("col").alias("v")))
    label = graph.vertices.select("node_id").join(stars.select(F.col("v").alias("node_id"), F.col("u").alias("c")), "node_id", "left")
    label = cut(label.select("node_id", F.coalesce("c", "node_id").alias("cluster_id")), "label")
    least = max(min_cluster_size, 1 if singletons else 2)
    big = label.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    clusters = cut(label.join(big, "cluster_id", "left_semi").select("cluster_id", "node_id"), "clusters")
    diag = m.where("row = col and val > 0").select(F.col("row").alias("node_id"), F.lit(True).alias("attractor"))
    top = m.groupBy(F.col("col").alias("node_id")).agg(F.max("val").alias("stability"))
    info = clusters.join(diag, "node_id", "left").join(top, "node_id", "left").select(
        "cluster_id", "node_id", F.coalesce("attractor", F.lit(False)).alias("attractor"), F.coalesce("stability", F.lit(0.0)).alias("stability"))
    # Rows and columns of an entry always share a cluster, so one join places the edge.
    edges = m.join(clusters.withColumnRenamed("node_id", "row"), "row").select("cluster_id", F.col("col").alias("src"), F.col("row").alias("dst"), F.col("val").alias("weight"))
    return MarkovClusters(m, clusters, info, edges)
