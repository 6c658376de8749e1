"""The end-to-end stages on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.plans.config import RunConfig, load_config
from tessella.plans.fixtures import NODES, RAW_EDGES, derive
from tessella.plans.measures import compute_clusters
from tessella.plans.stages import build_dataset, contact_graph, enrichment_report

SF = "/root/testdata/sf0.001"


def test_settings_merge(tmp_path):
    (tmp_path / "a.yaml").write_text("SEED: 7\nbin_size: 10\nlabel_col: None\nother: 1\n")
    (tmp_path / "b.yaml").write_text("bin_size: 12\n")
    c = load_config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), min_cc_size=2)
    assert (c.seed, c.bin_size, c.label_col, c.min_cc_size, c.extra) == (7, 12, None, 2, {"other": 1})


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_contacts_to_report_and_dataset(spark):
    raw = derive(spark, SF, RAW_EDGES).withColumns({c: F.lit(None).cast("double") for c in ("coulombs_energy", "lj_energy", "total_energy", "cleaned_lj_energy")})
    raw = raw.where("pdb_code in ('x1', 'x2', 'x3', 'x4')")  # few structures, so that nodes have the few contacts that clusters are made of
    # the smallest tables hold few mutations: enough of them for clusters to be tested
    table = derive(spark, SF, NODES).withColumn("total_mutations_count", 4 * F.col("total_mutations_count"))
    excluded = spark.createDataFrame([("X1",)], "`0` string")
    included = table.select(F.upper(F.split_part(F.split_part("node_id", F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1))).alias("uniprot"))
    g = contact_graph(raw, excluded, included, table.select("node_id"), blocked=["p00001"])
    assert g.edges.count() > 20 and g.edges.where("u >= v").count() == 0
    assert g.edges.where("u like 'p00001\\_%' or v like 'p00001\\_%'").count() == 0
    clusters = compute_clusters(g, ["MCL"], {"MCL": {"prune": 0.21}})["MCL"]
    rep = enrichment_report(clusters, table, "total_mutations_count", "sum", bins=4, mode="res", n_permutations=500)
    rows = rep.collect()
    assert rows and all(r.q_value >= r.p_value - 1e-12 for r in rows) and [r.p_value for r in rows] == sorted(r.p_value for r in rows)
    v = g.vertices.join(g.degrees().withColumnRenamed("deg", "degree"), "node_id").join(
        table.select("node_id", (F.col("total_mutations_count") > 0).cast("int").alias("is_mut")), "node_id")
    cfg = RunConfig(table_features=["ptms_mapped", "dssp_phi", "dssp_sec_struct", "total_mutations_count"], graph_features=["degree"],
                    node_att_norm_target=["degree"], min_cc_size=2, add_const_to_node=True)
    data = build_dataset(Graph(v, g.edges), table, cfg)
    first = data.nodes.first()
    assert len(first.x) == 1 + 3 + 3 + 1 and first.x[-1] == 1.0 and len(first.x_cat) == 1
    assert {r.split for r in data.nodes.select("split").distinct().collect()} >= {"train"}
    assert data.edges.count() <= g.edges.count()
    assert data.augmented.count() >= 0
