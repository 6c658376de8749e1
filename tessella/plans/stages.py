"""The three end-to-end stages: contacts to graph, clusters to report, graph to datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import dataset, edges, encode, enrichment, nodes
from tessella.operators.components import components_within, connected_components
from tessella.plans.config import RunConfig
from tessella.runtime import cut


def contact_graph(raw: DataFrame, excluded: DataFrame, included: DataFrame, applicable: DataFrame,
                  blocked: list[str] | None = None, inter_chain: bool = True, homodimers: bool = True) -> Graph:
    """Clean contact rows into a weighted graph; one plan up to the symmetric merge."""
    e = edges.drop_blocked_proteins(raw, blocked) if blocked else raw
    e = edges.keep_listed_proteins(edges.add_node_ids(e), excluded, included)
    e = edges.keep_listed_nodes(edges.keep_positive_positions(e), applicable)
    if inter_chain:
        e = edges.keep_inter_chain(e)
    if not homodimers:
        e = edges.drop_homodimer_copies(e)
    merged = edges.merge_symmetric(edges.drop_missing_energy(e))
    return Graph.from_edges(merged.withColumnRenamed("cleaned_total_energy", "weight"), "nodeid_1", "nodeid_2", ("weight",))


def enrichment_report(clusters: DataFrame, table: DataFrame, score: str = "avg_am_pathogenicity", statistic: str = "mean",
                      bins: int = 42, mode: str = "mut+res", n_permutations: int = 100_000, seed: int = 42) -> DataFrame:
    """Tested clusters with statistics and q-values, most significant first.

    ``table`` needs node_id, residue_name, mutability, total_mutations_count and
    the score.
    """
    binned = cut(encode.equal_width_bins(table, "mutability", "bin_mutability", bins), "binned")
    strata = cut(enrichment.with_strata(binned, score, mode), "strata")
    least = 5 if statistic == "sum" else None
    tested = enrichment.q_values(enrichment.permutation_test(clusters, strata, n_permutations, statistic, min_sum=least, seed=seed))
    stats = enrichment.cluster_statistics(clusters, binned, score).select("cluster_id", "num_mutated_node", "num_unique_uniprot")
    return tested.join(stats, "cluster_id").orderBy("p_value", "cluster_id")


@dataclass(frozen=True)
class Dataset:
    nodes: DataFrame   # graph_id, split, node_id, x, x_cat
    edges: DataFrame   # graph_id, u, v
    augmented: DataFrame  # component_id, anchor: kept balls of training components


def build_dataset(graph: Graph, table: DataFrame, config: RunConfig) -> Dataset:
    """Split components, encode and normalise features, augment the training part.

    ``graph.vertices`` carries the graph features and, for augmentation, is_mut.
    Label mappings are fitted once on the whole table.
    """
    g = graph.pinned()
    targets = [c for c in config.node_att_norm_target if c in g.vertices.columns]
    v = nodes.normalize(g.vertices, targets, config.node_att_norm_method) if targets else g.vertices
    comps = cut(components_within(connected_components(g), config.min_cc_size, config.max_cc_size).select("node_id", "component_id"), "comps")
    split = cut(dataset.split_components(comps, tuple(config.ratio_of_data), seed=config.seed), "split")
    t = encode.scale_scores(table, config.table_features)
    if "mut+res-bin" in config.table_features:
        t = encode.equal_width_bins(t, "mutability", "mut+res-bin", config.bin_size)
    enc = encode.encode_features(t, config.table_features)
    feats = [c for c in config.graph_features if c in v.columns]
    x = encode.assemble(v.join(comps, "node_id", "left_semi"), enc, feats, config.label_col, config.add_const_to_node)
    placed = comps.join(split.select("component_id", "split"), "component_id")
    rows = x.join(placed, "node_id").withColumnRenamed("component_id", "graph_id")
    inner = g.edges.join(comps.select(F.col("node_id").alias("u"), F.col("component_id").alias("graph_id")), "u")
    train = placed.where("split = 'train'").select("node_id")
    if config.use_aug and "is_mut" in v.columns:
        sub = g.induced(train)
        kept = dataset.distinct_balls(sub, dataset.anchored_balls(sub, steps=config.aug_subgraph_steps, ratio=0.1, seed=config.seed))
    else:
        kept = comps.select("component_id", F.col("node_id").alias("anchor")).limit(0)
    return Dataset(rows, inner.select("graph_id", "u", "v"), kept)


def save_dataset(data: Dataset, path: str) -> None:
    data.nodes.write.mode("overwrite").partitionBy("split").parquet(f"{path}/nodes")
    data.edges.write.mode("overwrite").parquet(f"{path}/edges")
    data.augmented.write.mode("overwrite").parquet(f"{path}/augmented")
