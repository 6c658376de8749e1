"""A cross-section of registered queries against their SQL at the smallest scale."""

import os

import pytest
from oracle_check import compare, connect

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
PICKS = [
    "merge_symmetric_edges", "filter_weak_edges", "join_driver_status", "node_mutability", "encode_labels", "assemble_features", "scan_fasta",
    "connected_components", "measure_pagerank", "measure_betweenness", "measure_k_truss", "measure_bridges", "cluster_mcl_edges", "cluster_dbscan",
    "expected_null", "enriched_clusters", "q_values", "anchored_balls", "sage_layer",
]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", PICKS)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), queries()[name], oracle_sql()[name], SF) is None
