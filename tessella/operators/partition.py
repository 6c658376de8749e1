"""Signed partitioning: drop repelling edges, take components as clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.components import component_sizes, connected_components
from tessella.operators.edges import drop_repulsive, drop_weak_or_repulsive
from tessella.runtime import cut


def partition(graph: Graph, mode: str = "repulsive", threshold: int = 25, weight: str = "weight") -> DataFrame:
    """(node_id, component_id) after dropping edges by sign ('repulsive', 'repulsive_or_zero') or strength ('threshold')."""
    if mode == "threshold":
        kept = drop_weak_or_repulsive(graph.edges, threshold, weight)
    elif mode in ("repulsive", "repulsive_or_zero"):
        kept = drop_repulsive(graph.edges, weight, with_zero=mode == "repulsive_or_zero")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return connected_components(Graph(graph.vertices, kept))


def partition_clusters(components: DataFrame, min_nodes: int = 2) -> DataFrame:
    """(cluster_id, node_id) of components with at least ``min_nodes`` nodes."""
    comps = cut(components, "comps")
    big = component_sizes(comps).where(F.col("n_nodes") >= min_nodes).select("component_id")
    return comps.join(big, "component_id", "left_semi").select(F.col("component_id").alias("cluster_id"), "node_id")
