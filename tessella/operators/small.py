"""Components of few nodes, worked on as arrays, many of them in a task.

A graph of millions of small components costs rounds of joins what one pass over
its edges gives: the edges of a component are brought together, and components of
equal size are laid on each other as one array with a first axis for components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.components import connected_components
from tessella.runtime import cut, no_rows, ship

# Nodes of a component up to which it is worked on in one task.
NODES = 64
# Rows held at a time in a task.
STRETCH = 500_000
# Cells of the arrays made at a time.
CELLS = 2_000_000


def on_whole(rows: DataFrame, run: Callable[..., list], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``run`` makes of the columns of ``rows``, given as arrays.

    The first column is a key. A call gets all rows of every key it gets, sorted by key.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(last: bool) -> pa.RecordBatch:
            cols = [np.concatenate([part[k] for part in held]) for k in range(len(held[0]))]
            end = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
            held[:] = [[c[end:] for c in cols]]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in run(*[c[:end] for c in cols])], names)

        for b in batches:
            if b.num_rows == 0:
                continue
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)])
            count += b.num_rows
            if count >= STRETCH and held[0][0][0] != held[-1][0][-1]:
                yield flush(False)
                count = len(held[0][0])
        if count:
            yield flush(True)

    ship(rows.sparkSession)
    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(told, schema)


def parted(graph: Graph, components: DataFrame | None = None, nodes: int = NODES) -> tuple[DataFrame | None, Graph | None]:
    """The edges (component_id, u, v, ...) of components of at most ``nodes`` nodes, and the graph of all others.

    Either is None if there is nothing in it. Nodes that are not whole numbers all
    go with the others. The ends of all edges are vertices; self-loops are left out.
    """
    edges = graph.edges.where("u <> v")
    if nodes < 2 or graph.vertices.schema["node_id"].dataType.simpleString() not in ("bigint", "int"):
        return None, graph
    comps = cut(connected_components(graph), "comps") if components is None else components
    far = cut(comps.groupBy("component_id").agg(F.count("*").alias("size")).where(F.col("size") > nodes).select("component_id"), "far")
    home = comps.select(F.col("node_id").alias("u"), "component_id")
    order = ["component_id", *graph.edges.columns]
    if no_rows(far):
        return edges.join(home, "u").select(*order), None
    placed = edges.join(home, "u")
    rest = Graph(
        graph.vertices.join(comps.join(far, "component_id", "left_semi").select("node_id"), "node_id", "left_semi"),
        placed.join(far, "component_id", "left_semi").select(*graph.edges.columns))
    return placed.join(far, "component_id", "left_anti").select(*order), rest.pinned()


def apart(rows: DataFrame, graph: Graph, key: str, nodes: int = NODES) -> tuple[DataFrame | None, DataFrame | None]:
    """``rows`` of components of at most ``nodes`` nodes, led by component_id, and all others; None for what has no rows.

    The node ``key`` of a row tells its component. Nodes that are not whole numbers all go with the others.
    """
    if nodes < 2 or graph.vertices.schema["node_id"].dataType.simpleString() not in ("bigint", "int"):
        return None, cut(rows, "apart")
    comps = cut(connected_components(graph), "comps")
    far = cut(comps.groupBy("component_id").agg(F.count("*").alias("size")).where(F.col("size") > nodes).select("component_id"), "far")
    placed = cut(rows.join(comps.withColumnRenamed("node_id", key), key).select("component_id", *rows.columns), "apart")
    if no_rows(far):
        return placed, None
    near, rest = placed.join(far, "component_id", "left_anti"), placed.join(far, "component_id", "left_semi").drop("component_id")
    return None if no_rows(near) else near, cut(rest, "apart")


def stacks(component: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Components of equal size at a time: nodes (k, n), and of their edges the component, both ends' places in it and the row."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u):]
    home = np.empty(len(names), component.dtype)
    home[i] = home[j] = component
    order = np.argsort(home, kind="stable")
    ids, first, size = np.unique(home[order], return_index=True, return_counts=True)
    slot = np.empty(len(names), np.int64)
    slot[order] = np.arange(len(names)) - np.repeat(first, size)
    owner = np.searchsorted(ids, component)
    for n in np.unique(size):
        members, step = np.flatnonzero(size == n), max(1, CELLS // int(n * n))
        for a in range(0, len(members), step):
            some = members[a : a + step]
            place = np.full(len(ids), -1)
            place[some] = np.arange(len(some))
            rows = np.flatnonzero(place[owner] >= 0)
            yield names[order[first[some][:, None] + np.arange(n)]], place[owner[rows]], slot[i[rows]], slot[j[rows]], rows


def gathered(parts: list[tuple[np.ndarray, ...]], kinds: list) -> list[np.ndarray]:
    """The columns of ``parts`` one below the other; without parts, empty ones of the given kinds."""
    return [np.concatenate([p[k].ravel() for p in parts]) if parts else np.empty(0, kind) for k, kind in enumerate(kinds)]
