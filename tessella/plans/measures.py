"""Measures and clusterings by name, checked before any of them runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import betweenness, blocks, cores, density, distances, flow, local, mcl, modularity, partition, ranking, seeds, spectral, weighted
from tessella.operators.cliques import maximal_clique_centrality


def _number(graph: Graph, name: str, value: float) -> DataFrame:
    return graph.edges.sparkSession.createDataFrame([(float(value),)], f"{name} double")


def _densest(graph: Graph) -> DataFrame:
    value, members = cores.densest_peel(graph)
    return members.withColumn("density", F.lit(value))


# Tables keyed by node, edge or set, or a single row for a number.
MEASURES: dict[str, Callable[[Graph], DataFrame]] = {
    "degree": local.degree_centrality,
    "transitivity": local.transitivity,
    "triangles": local.triangles,
    "k_truss": cores.truss_sizes,
    "k_core": cores.core_numbers,
    "betweenness": betweenness.betweenness,
    "edge_betweenness": betweenness.edge_betweenness,
    "closeness": distances.harmonic,
    "shortest_path_length_per_node": distances.mean_distance_per_node,
    "w_shortest_path_length": lambda g: weighted.mean_weighted_distance(g) if "weight" in g.edges.columns else distances.mean_distance_per_node(g),
    "avg_short_path_len": distances.mean_distance_per_component,
    "global_efficiency": distances.global_efficiency,
    "local_efficiency": distances.local_efficiency,
    "eigenvector": ranking.eigenvector,
    "pagerank": ranking.pagerank,
    "local_clustering": local.local_clustering,
    "articulation_point": blocks.articulation_points,
    "bridges": blocks.bridges,
    "biconnected_components": blocks.biconnected_components,
    "deg_assortativity": local.degree_assortativity,
    "alg_connectivity": lambda g: _number(g, "alg_connectivity", spectral.algebraic_connectivity(g)),
    "spectral_radius": lambda g: _number(g, "spectral_radius", spectral.spectral_radius(g, "weight" if "weight" in g.edges.columns else None)),
    "flow_betweenness": lambda g: flow.flow_measures(g).select("node_id", "flow_betweenness"),
    "flow_closeness": lambda g: flow.flow_measures(g).select("node_id", "flow_closeness"),
    "louvain_comm": modularity.louvain,
    "densest_subgraph": _densest,
    "MCC": maximal_clique_centrality,
}

CLUSTERINGS: dict[str, Callable[..., DataFrame]] = {
    "MCL": lambda g, **p: mcl.markov_clusters(g, **{"expansion": 5, "inflation": 3, "prune": 0.11, "singletons": False, **p}).clusters,
    "DBSCAN": lambda g, **p: density.cluster_keys(density.dbscan(g, **p)),
    "HDBSCAN": lambda g, **p: density.cluster_keys(density.hdbscan(g, **p)),
    "DPClus": seeds.dpclus,
    "EAGLE": seeds.eagle,
    "CDBN": seeds.boundary_communities,
    "partition": partition.partition,
}


def _checked(names: list[str], known: dict) -> list[str]:
    picked = list(known) if "all" in names else names
    unknown = [n for n in picked if n not in known]
    if unknown:
        raise ValueError(f"unknown: {unknown}; known: {sorted(known)}")
    return picked


def _att_assortativity(graph: Graph, attributes: dict[str, str]) -> DataFrame:
    """(attribute, assortativity) for node columns named with their kind, numeric or categorical."""
    kinds = {"numeric": local.numeric_assortativity, "categorical": local.categorical_assortativity}
    parts = [kinds[kind](graph, name).select(F.lit(name).alias("attribute"), F.col("assortativity").cast("double").alias("assortativity")) for name, kind in attributes.items()]
    return reduce(DataFrame.unionAll, parts)


def compute_measures(graph: Graph, names: list[str], attributes: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The named measures ('all' for every one) of the graph without self-loops.

    ``attributes`` ({node column: "numeric" or "categorical"}) adds ``att_assortativity`` to the known ones.
    """
    known = {**MEASURES, **({"att_assortativity": lambda g: _att_assortativity(g, attributes)} if attributes else {})}
    picked = _checked(names, known)
    g = graph.without_loops().pinned()
    return {n: known[n](g) for n in picked}


def compute_clusters(graph: Graph, names: list[str], params: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    picked = _checked(names, CLUSTERINGS)
    g = graph.pinned()
    return {n: CLUSTERINGS[n](g, **(params or {}).get(n, {})) for n in picked}
