import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark import SparkContext

    from tessella.runtime import build_session

    SparkContext.setSystemProperty("spark.ui.showConsoleProgress", "false")
    SparkContext.setSystemProperty("spark.ui.enabled", "false")
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    from tessella.graph import Graph

    def build(pairs, nodes=(), weights=None):
        if weights:
            df = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(pairs, weights)], "u long, v long, weight double")
            g = Graph.from_edges(df, attrs=("weight",))
        else:
            g = Graph.from_edges(spark.createDataFrame([tuple(p) for p in pairs], "u long, v long"))
        if nodes:
            extra = spark.createDataFrame([(n,) for n in nodes], "node_id long")
            g = Graph(g.vertices.unionByName(extra).distinct(), g.edges)
        return g.pinned()

    return build
