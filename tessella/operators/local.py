"""Degree, triangle and assortativity measures: joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph


def degree_centrality(graph: Graph) -> DataFrame:
    """(node_id, degree): neighbours / (n - 1); 1 on a single node."""
    n = graph.vertices.count()
    return graph.degrees().select("node_id", (F.col("deg") / (n - 1) if n > 1 else F.lit(1.0)).alias("degree"))


def triangle_list(graph: Graph) -> DataFrame:
    """(a, b, c) once per triangle.

    Edges run from the lower to the higher (degree, id), so a node starts at
    most sqrt(2 E) of them and a hub starts almost none: the number of paths
    joined below stays within E^1.5 whatever the degrees are.
    """
    e = graph.edges.where("u <> v").select("u", "v")
    d = graph.degrees()
    ranked = e.join(d.select(F.col("node_id").alias("u"), F.col("deg").alias("du")), "u").join(
        d.select(F.col("node_id").alias("v"), F.col("deg").alias("dv")), "v"
    )
    ru, rv = F.struct(F.col("du").alias("k"), F.col("u").alias("n")), F.struct(F.col("dv").alias("k"), F.col("v").alias("n"))
    arcs = ranked.select(F.least(ru, rv).alias("s"), F.greatest(ru, rv).alias("t")).select(
        F.col("s.n").alias("a"), F.col("t.n").alias("b"), F.col("t.k").alias("kb")
    )
    other = arcs.select("a", F.col("b").alias("c"), F.col("kb").alias("kc"))
    paths = arcs.join(other, "a").where(F.struct("kb", "b") < F.struct(F.col("kc"), F.col("c"))).select("a", "b", "c")
    closing = arcs.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return paths.join(closing, ["b", "c"]).select("a", "b", "c")


def triangles(graph: Graph, listed: DataFrame | None = None) -> DataFrame:
    """(node_id, triangles) for every vertex."""
    t = listed if listed is not None else triangle_list(graph)
    per = t.select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("t"))
    return graph.vertices.select("node_id").join(per, "node_id", "left").select(
        "node_id", F.coalesce("t", F.lit(0)).cast("long").alias("triangles")
    )


def edge_triangles(graph: Graph, listed: DataFrame | None = None) -> DataFrame:
    """(u, v, common): number of common neighbours of each edge's ends."""
    t = listed if listed is not None else triangle_list(graph)

    def side(x: str, y: str):
        return F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))

    sides = t.select(F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).select("e.*")
    per = sides.groupBy("u", "v").agg(F.count("*").alias("c"))
    e = graph.edges.where("u <> v").select("u", "v")
    return e.join(per, ["u", "v"], "left").select("u", "v", F.coalesce("c", F.lit(0)).cast("long").alias("common"))


def local_clustering(graph: Graph) -> DataFrame:
    t = triangles(graph).join(graph.degrees(), "node_id")
    d = F.col("deg")
    value = F.when(d < 2, 0.0).otherwise(2.0 * F.col("triangles") / (d * (d - 1)))
    return t.select("node_id", value.alias("local_clustering"))


def transitivity(graph: Graph) -> DataFrame:
    """One row: 3 x triangles / connected triples, rounded to 6 places."""
    t = triangles(graph).agg(F.sum("triangles").alias("t3"))
    w = graph.degrees().agg(F.sum(F.expr("deg * (deg - 1) / 2")).alias("w"))
    r = F.when(F.coalesce(w.scalar(), F.lit(0.0)) == 0, 0.0).otherwise(F.col("t3") / w.scalar())
    return t.select(F.round(r, 6).alias("transitivity"))


def degree_assortativity(graph: Graph) -> DataFrame:
    """One row: Pearson correlation of end degrees over both edge directions."""
    d = graph.degrees()
    s = graph.sym().select("a", "b")
    both = s.join(d.select(F.col("node_id").alias("a"), F.col("deg").alias("x")), "a").join(
        d.select(F.col("node_id").alias("b"), F.col("deg").alias("y")), "b"
    )
    return both.agg(F.round(F.corr("x", "y"), 5).alias("deg_assortativity"))


def numeric_assortativity(graph: Graph, attribute: str) -> DataFrame:
    """One row: Pearson correlation of a numeric node attribute over both edge directions."""
    v = graph.vertices.select("node_id", F.col(attribute).cast("double").alias("w"))
    both = graph.sym().select("a", "b").join(v.select(F.col("node_id").alias("a"), F.col("w").alias("x")), "a").join(
        v.select(F.col("node_id").alias("b"), F.col("w").alias("y")), "b"
    )
    return both.agg(F.corr("x", "y").alias("assortativity"))


def categorical_assortativity(graph: Graph, attribute: str) -> DataFrame:
    """One row: (tr e - sum a b) / (1 - sum a b) of the attribute mixing matrix."""
    v = graph.vertices.select("node_id", F.col(attribute).alias("w"))
    mix = (
        graph.sym().select("a", "b")
        .join(v.select(F.col("node_id").alias("a"), F.col("w").alias("x")), "a")
        .join(v.select(F.col("node_id").alias("b"), F.col("w").alias("y")), "b")
        .groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    )
    total = mix.agg(F.sum("n"))
    # The matrix is symmetric, so row and column shares agree.
    share = mix.groupBy("x").agg(F.sum("n").alias("r")).agg(F.sum(F.col("r") * F.col("r")))
    trace = mix.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0.0)).alias("tr"))
    ab = share.scalar() / (total.scalar() * total.scalar())
    return trace.select(((F.col("tr") / total.scalar() - ab) / (1 - ab)).alias("assortativity"))
