"""Current-flow closeness and betweenness, per connected component.

A component small enough for one task is solved densely there; those of few nodes
are inverted together, many in a task. Larger ones are
solved by conjugate gradients on a table with one row per (source, node), in
which the sources are as many independent right-hand sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.graph import Graph, symmetric
from tessella.operators.components import connected_components
from tessella.operators.small import NODES, gathered, on_whole, parted, stacks
from tessella.runtime import cut, no_rows

# Nodes of a component up to which its dense inverse is formed in one task.
DENSE_NODES = 1000


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (component_id, u, v) of one component to (node_id, flow_closeness, flow_betweenness)."""
    nodes = pd.unique(pd.concat([pdf.u, pdf.v]))
    at = pd.Series(np.arange(len(nodes)), index=nodes)
    i, j, n = at[pdf.u].to_numpy(), at[pdf.v].to_numpy(), len(nodes)
    lap = np.zeros((n, n))
    lap[i, j] = lap[j, i] = -1.0
    lap[np.arange(n), np.arange(n)] = -lap.sum(axis=1)
    inv = np.linalg.inv(lap + 1.0 / n) - 1.0 / n
    close = 1.0 / (n * np.diag(inv) + np.trace(inv))
    # For every edge, the total |flow| over all source-target pairs from its sorted potentials.
    pot = np.sort(inv[i] - inv[j], axis=1)
    through = pot @ (2.0 * np.arange(1, n + 1) - n - 1)
    load = np.bincount(i, through, n) + np.bincount(j, through, n)
    between = (load - (n - 1)) / ((n - 1) * (n - 2)) if n > 2 else np.zeros(n)
    return pd.DataFrame({"node_id": nodes, "flow_closeness": close, "flow_betweenness": between})


def _local_flow(component: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Columns node, flow_closeness, flow_betweenness of whole components of equal sizes at a time."""
    out = []
    for nodes, c, i, j, _ in stacks(component, u, v):
        k, n = nodes.shape
        own = np.arange(n)
        lap = np.zeros((k, n, n))
        lap[c, i, j] = lap[c, j, i] = -1.0
        lap[:, own, own] = -lap.sum(axis=2)
        inv = np.linalg.inv(lap + 1.0 / n) - 1.0 / n
        diag = inv[:, own, own]
        close = 1.0 / (n * diag + diag.sum(axis=1, keepdims=True))
        through = np.sort(inv[c, i] - inv[c, j], axis=1) @ (2.0 * np.arange(1, n + 1) - n - 1)
        load = (np.bincount(c * n + i, through, k * n) + np.bincount(c * n + j, through, k * n)).reshape(k, n)
        out.append((nodes, close, (load - (n - 1)) / ((n - 1) * (n - 2)) if n > 2 else np.zeros((k, n))))
    return gathered(out, [u.dtype, float, float])


def _potentials(nodes: DataFrame, arcs: DataFrame, tol: float = 1e-11) -> DataFrame:
    """(component_id, src, node_id, x): column ``src`` of the Laplacian pseudo-inverse.

    ``nodes(component_id, node_id, deg, n)``.
    """
    src = nodes.select("component_id", F.col("node_id").alias("src"))
    b = F.when(F.col("src") == F.col("node_id"), 1.0).otherwise(0.0) - 1.0 / F.col("n")
    state = cut(nodes.join(src, "component_id").select(
        "component_id", "src", "node_id", "deg", "n", F.lit(0.0).alias("x"), b.alias("r"), b.alias("p")), "cg")
    limit = nodes.agg(F.max("n")).first()[0] + 5
    for _ in range(limit):
        pa = state.select("src", F.col("node_id").alias("a"), "p")
        near = arcs.join(pa, "a").groupBy("src", F.col("b").alias("node_id")).agg(F.sum("p").alias("s"))
        ap = cut(state.join(near, ["src", "node_id"], "left").withColumn("ap", F.col("deg") * F.col("p") - F.coalesce("s", F.lit(0.0))).drop("s"), "cg")
        one = ap.groupBy("src").agg((F.sum(F.col("r") * F.col("r"))).alias("rr"), F.sum(F.col("p") * F.col("ap")).alias("pap"))
        alpha = F.when(F.col("pap") > 0, F.col("rr") / F.col("pap")).otherwise(0.0)
        step = cut(ap.join(one, "src").withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap")).drop("ap", "pap"), "cg")
        new = step.groupBy("src").agg(F.sum(F.col("r") * F.col("r")).alias("rn"))
        beta = F.when(F.col("rr") > 0, F.col("rn") / F.col("rr")).otherwise(0.0)
        state = step.join(new, "src").withColumn("p", F.col("r") + beta * F.col("p")).drop("rr", "rn")
        if (new.agg(F.max("rn")).first()[0] or 0.0) < tol * tol:
            break
        state = cut(state, "cg")
    return state.select("component_id", "src", "node_id", "n", "x")


def _solved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, flow_closeness, flow_betweenness) for components beyond the dense bound."""
    x = cut(_potentials(nodes, cut(symmetric(edges.select("u", "v")), "arcs")), "potentials")
    own = x.where("src = node_id").select("component_id", "node_id", "n", F.col("x").alias("d"))
    tr = own.groupBy("component_id").agg(F.sum("d").alias("tr"))
    close = own.join(tr, "component_id").select("node_id", "n", (1.0 / (F.col("n") * F.col("d") + F.col("tr"))).alias("flow_closeness"))
    pot = edges.select("u", "v").join(x.select(F.col("node_id").alias("u"), "src", "n", F.col("x").alias("xu")), "u").join(
        x.select(F.col("node_id").alias("v"), "src", F.col("x").alias("xv")), ["v", "src"]).withColumn("p", F.col("xu") - F.col("xv"))
    rank = F.row_number().over(Window.partitionBy("u", "v").orderBy("p"))
    through = pot.withColumn("t", F.col("p") * (2.0 * rank - F.col("n") - 1)).groupBy("u", "v").agg(F.sum("t").alias("t"))
    load = through.select(F.explode(F.array("u", "v")).alias("node_id"), "t").groupBy("node_id").agg(F.sum("t").alias("load"))
    n = F.col("n")
    between = F.when(n > 2, (F.col("load") - (n - 1)) / ((n - 1) * (n - 2))).otherwise(0.0)
    return close.join(load, "node_id").select("node_id", "flow_closeness", between.alias("flow_betweenness"))


def flow_measures(graph: Graph, dense_nodes: int = DENSE_NODES, small_nodes: int = NODES) -> DataFrame:
    """(node_id, flow_closeness, flow_betweenness): both measures of every component.

    Closeness is 1 / (sum of effective resistances); betweenness is normalised
    by (n - 1)(n - 2) / 2. Isolated nodes get null and 0. Components of at most
    ``small_nodes`` and ``dense_nodes`` nodes go many to a task, those of at most
    ``dense_nodes`` one by one.
    """
    g = Graph(graph.vertices, cut(graph.edges.where("u <> v").select("u", "v"), "edges"))
    comps = cut(connected_components(g), "comps")
    kind = graph.vertices.schema["node_id"].dataType.simpleString()
    schema = f"node_id {kind}, flow_closeness double, flow_betweenness double"
    near, rest = parted(g, comps, min(small_nodes, dense_nodes))
    out = None if near is None else on_whole(near, _local_flow, schema)
    if rest is not None:
        more = _by_component(rest, comps.join(rest.vertices, "node_id", "left_semi"), dense_nodes, schema)
        out = more if out is None else out.unionByName(more)
    return graph.vertices.select("node_id").join(out, "node_id", "left").select(
        "node_id", "flow_closeness", F.coalesce("flow_betweenness", F.lit(0.0)).alias("flow_betweenness"))


def _by_component(g: Graph, comps: DataFrame, dense_nodes: int, schema: str) -> DataFrame:
    """The measures of the nodes that have edges, one component in a task or by conjugate gradients."""
    sizes = cut(comps.groupBy("component_id").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "sizes")
    edges = g.edges.join(comps.withColumnRenamed("node_id", "u"), "u")
    small = edges.join(sizes.where(F.col("n") <= dense_nodes).select("component_id"), "component_id", "left_semi")
    out = small.groupBy("component_id").applyInPandas(_dense, schema)
    large = sizes.where(F.col("n") > dense_nodes)
    if not no_rows(large):
        nodes = cut(comps.join(large, "component_id").join(g.degrees(), "node_id"), "nodes")
        out = out.unionByName(_solved(nodes, edges.join(large.select("component_id"), "component_id", "left_semi").select("u", "v")))
    return out
