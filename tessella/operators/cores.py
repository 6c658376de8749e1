"""Core and truss numbers by repeated h-index, and the densest peel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.local import triangle_list
from tessella.runtime import cut, no_rows


def _h_index(levels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h: the largest h such that at least h of the summed counts have level >= h.

    ``levels(keys, level, n)`` is already counted per level, so a hub brings as
    many rows as it has distinct levels, not as many as it has neighbours.
    """
    down = Window.partitionBy(*keys).orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reach = levels.withColumn("c", F.sum("n").over(down))
    return reach.groupBy(*keys).agg(F.max(F.least("level", "c")).cast("long").alias("h"))


def core_numbers(graph: Graph) -> DataFrame:
    """(node_id, k_core): lowering every node to the h-index of its neighbours until nothing moves."""
    sym = cut(graph.sym().select("a", F.col("b").alias("_to")), "sym")
    cur = cut(graph.degrees().select("node_id", F.col("deg").alias("h")), "core")
    total = None
    while True:
        own = cur.select(F.col("node_id").alias("_to"), F.col("h").alias("cap"))
        near = cur.join(sym, cur["node_id"] == sym["a"]).select("_to", "h").groupBy("_to", "h").agg(F.count("*").alias("n"))
        levels = near.join(own, "_to").groupBy(F.col("_to").alias("node_id"), F.least("h", "cap").alias("level")).agg(F.sum("n").alias("n"))
        new = cur.select("node_id").join(_h_index(levels, ["node_id"]), "node_id", "left").select("node_id", F.coalesce("h", F.lit(0)).cast("long").alias("h"))
        cur = cut(new, "core")
        s = cur.agg(F.sum("h")).first()[0]
        if s == total:
            return cur.select("node_id", F.col("h").alias("k_core"))
        total = s


def truss_numbers(graph: Graph) -> DataFrame:
    """(u, v, truss): the largest k such that the edge is in the k-truss (2 without triangles)."""
    t = cut(triangle_list(graph), "triangles")

    def side(x: str, y: str):
        return F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))

    tri = cut(t.select(F.struct("a", "b", "c").alias("t"), F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).select("t", "e.u", "e.v"), "sides")
    cur = cut(tri.groupBy("u", "v").agg(F.count("*").alias("h")), "truss")
    total = None
    while True:
        own = tri.join(cur, ["u", "v"])
        # Of the two other sides only the weaker one matters: the two least values of the triangle settle it.
        low = own.groupBy("t").agg(F.min(F.struct("h", "u", "v")).alias("m1"), F.sum("h").alias("s"), F.max("h").alias("mx"))
        second = F.col("s") - F.col("m1.h") - F.col("mx")
        levels = (
            own.join(low, "t")
            .withColumn("other", F.when((F.col("m1.u") == F.col("u")) & (F.col("m1.v") == F.col("v")), second).otherwise(F.col("m1.h")))
            .groupBy("u", "v", F.least("other", "h").alias("level")).agg(F.count("*").alias("n"))
        )
        cur = cut(_h_index(levels, ["u", "v"]), "truss")
        s = cur.agg(F.sum("h")).first()[0]
        if s == total:
            break
        total = s
    e = graph.edges.where("u <> v").select("u", "v")
    return e.join(cur, ["u", "v"], "left").select("u", "v", (F.coalesce("h", F.lit(0)) + 2).cast("long").alias("truss"))


def truss_sizes(graph: Graph, max_k: int | None = None) -> DataFrame:
    """(k, n_nodes) of the k-truss for k = 3 .. max_k - 1 (all k by default); the single row (-1, -1) if there is none."""
    tn = cut(truss_numbers(graph), "truss")
    top = tn.agg(F.max("truss")).first()[0] or 2
    if top < 3:
        return graph.edges.sparkSession.createDataFrame([(-1, -1)], "k long, n_nodes long")
    per = tn.select(F.explode(F.array("u", "v")).alias("node_id"), "truss").groupBy("node_id").agg(F.max("truss").alias("truss"))
    hist = per.where("truss >= 3").groupBy("truss").agg(F.count("*").alias("n"))
    # A node of truss t lies in every k-truss up to t; hist has a row for each truss number.
    ks = hist.select(F.explode(F.sequence(F.lit(3).cast("long"), F.col("truss") if max_k is None else F.least("truss", F.lit(max_k - 1)))).alias("k"), "n")
    return ks.groupBy("k").agg(F.sum("n").alias("n_nodes"))


def densest_peel(graph: Graph) -> tuple[float, DataFrame]:
    """(density, members): the best edge/node ratio met while peeling low degrees.

    As long as some node has a degree below the present density, taking all
    such nodes out raises it; when none is left the nodes of least degree go.
    At least half of the best possible density, like one-by-one peeling.
    """
    edges = cut(graph.edges.where("u <> v").select("u", "v"), "peel")
    best, best_edges = 0.0, edges
    while True:
        deg = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("deg"))
        deg = cut(deg, "deg")
        n, s, low = deg.agg(F.count("*"), F.sum("deg"), F.min("deg")).first()
        if not n:
            break
        density = s / 2 / n
        if density > best:
            best, best_edges = density, edges
        gone = deg.where(F.col("deg") < density) if low < density else deg.where(F.col("deg") == low)
        gone = gone.select("node_id")
        edges = cut(
            edges.join(gone.withColumnRenamed("node_id", "u"), "u", "left_anti")
            .join(gone.withColumnRenamed("node_id", "v"), "v", "left_anti").select("u", "v"), "peel")
        if no_rows(edges):
            break
    members = best_edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return best, members
