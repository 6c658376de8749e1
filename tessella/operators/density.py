"""Density clustering over hop distance, without any table of node pairs.

Two cores are linked when at most ``eps`` hops apart. With r = eps // 2 they
then meet in a node (or, for odd eps, across an edge) within r hops of both, so
it is enough to spread every core r layers outwards. A node of a layer stands
for all cores that reach it; it is named by the least of those that the layer
before hands it, and the others are linked with that one: about as many links
between cores as there are edges, for each layer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators.components import component_edges, connected_components
from tessella.operators.distances import distance_profile
from tessella.runtime import cut


def _core_groups(sym: DataFrame, cores: DataFrame, eps: int) -> DataFrame:
    """(node_id, label) for the cores: least core of the chain of cores within eps hops."""
    half, odd = divmod(eps, 2)
    step = sym.select("a", F.col("b").alias("_to"))
    layer, links = cores.select("node_id", F.col("node_id").alias("rep")), []
    for _ in range(half):
        out = cut(layer.join(step, layer["node_id"] == step["a"]).select(F.col("_to").alias("node_id"), "rep").unionAll(layer), "reach")
        least = cut(out.groupBy("node_id").agg(F.min("rep").alias("least")), "layer")
        links.append(out.join(least, "node_id").where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")))
        layer = least.withColumnRenamed("least", "rep")
    if odd:
        other = layer.select(F.col("node_id").alias("_to"), F.col("rep").alias("_rep"))
        across = layer.join(step, layer["node_id"] == step["a"]).join(other, "_to")
        links.append(across.select(F.col("rep").alias("u"), F.col("_rep").alias("v")))
    stars = component_edges(reduce(DataFrame.unionAll, links))
    lab = stars.select(F.col("v").alias("node_id"), F.col("u").alias("g"))
    return cores.select("node_id").join(lab, "node_id", "left").select("node_id", F.coalesce("g", "node_id").alias("label"))


def _within(profile: DataFrame, vertices: DataFrame, eps: int) -> DataFrame:
    """(node_id, n): nodes within eps hops, itself included."""
    near = profile.where(F.col("d") <= eps).groupBy("node_id").agg(F.sum("n").alias("n"))
    return vertices.select("node_id").join(near, "node_id", "left").select("node_id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def dbscan(graph: Graph, eps: float = 2, min_samples: int = 4) -> DataFrame:
    """(node_id, component_id, cluster_id, core).

    The cluster id is the least core of the cluster and null for noise. A border
    node within reach of several clusters goes to the one of least id.
    """
    eps = int(eps)
    g = Graph(graph.vertices, cut(graph.edges.where("u <> v").select("u", "v"), "edges"))
    comps = cut(connected_components(g), "comps")
    near = _within(distance_profile(g, eps, comps), g.vertices, eps)
    cores = cut(near.where(F.col("n") >= min_samples).select("node_id"), "cores")
    sym = cut(g.sym(), "sym")
    lab = cut(_core_groups(sym, cores, eps), "label")
    flood = lab
    step = sym.select("a", F.col("b").alias("_to"))
    for _ in range(eps):
        spread = flood.join(step, flood["node_id"] == step["a"]).select(F.col("_to").alias("node_id"), "label")
        flood = cut(spread.unionAll(flood).groupBy("node_id").agg(F.min("label").alias("label")), "flood")
    own = lab.withColumnRenamed("label", "own")
    return comps.join(flood, "node_id", "left").join(own, "node_id", "left").select(
        "node_id", "component_id", F.coalesce("own", "label").alias("cluster_id"), F.col("own").isNotNull().alias("core"))


def cluster_keys(labelled: DataFrame) -> DataFrame:
    """(cluster_key, node_id): ids that carry the component; the noise of a component is a cluster of its own."""
    c = F.coalesce(F.col("cluster_id").cast("string"), F.lit("-1"))
    return labelled.select(F.concat_ws("_", F.lit("sub"), F.col("component_id").cast("string"), c).alias("cluster_key"), "node_id")


def hdbscan(graph: Graph, min_cluster_size: int = 5, min_samples: int = 3, method: str = "eom", allow_single_cluster: bool = False) -> DataFrame:
    """(node_id, component_id, cluster_id, probability).

    Hop distances are whole numbers, so the hierarchy of a component has a level
    per hop up to its largest core distance (below ``min_samples``), and a level
    is the grouping of the cores at eps = level. All merges of one distance
    happen at once instead of in an arbitrary order.
    """
    g = Graph(graph.vertices, cut(graph.edges.where("u <> v").select("u", "v"), "edges"))
    comps = cut(connected_components(g), "comps")
    top = max(min_samples - 1, 1)
    prof = cut(distance_profile(g, top, comps), "profile")
    core = reduce(
        lambda acc, d: acc.join(_within(prof, g.vertices, d).withColumnRenamed("n", f"n{d}"), "node_id"), range(1, top + 1), g.vertices.select("node_id"))
    when = F.coalesce(*[F.when(F.col(f"n{d}") >= min_samples, F.lit(d)) for d in range(1, top + 1)])
    core = cut(core.select("node_id", when.alias("core")), "core")
    sym = cut(g.sym(), "sym")
    # Points with the label of their group at each level.
    pts = core.where("core is not null").select("node_id")
    for level in range(1, top + 1):
        lab = _core_groups(sym, cut(core.where(F.col("core") <= level), "cores"), level).withColumnRenamed("label", f"g{level}")
        pts = cut(pts.join(lab, "node_id", "left"), "pts")
    # Tree nodes: groups large enough to be clusters.
    def groups(level: int) -> DataFrame:
        up = F.col(f"g{level + 1}") if level < top else F.lit(None)
        return pts.where(f"g{level} is not null").groupBy(F.col(f"g{level}").alias("g")).agg(
            F.count("*").alias("size"), F.max(up).alias("up")).where(F.col("size") >= min_cluster_size)

    # cid of a group: that of its parent while the parent has one large child, else its own (level, group).
    tree = cut(groups(top).select("g", F.struct(F.lit(top).alias("l"), F.col("g").alias("n")).alias("cid")), "tree")
    clusters = tree.select("cid", F.lit(0.0).alias("birth"), F.lit(None).cast(tree.schema["cid"].dataType).alias("parent"))
    placed = pts.join(tree.toDF("_g", "cid"), pts[f"g{top}"] == F.col("_g"), "left").select(
        pts["*"], "cid", F.when(F.col("cid").isNotNull(), F.lit(1.0 / top)).alias("lam"))
    for level in range(top - 1, 0, -1):
        kids = groups(level).join(tree.toDF("_g", "pc"), F.col("up") == F.col("_g")).select("g", "up", "size", "pc")
        many = kids.groupBy("up").agg(F.count("*").alias("k"))
        new_id = F.struct(F.lit(level).alias("l"), F.col("g").alias("n"))
        kids = cut(kids.join(many, "up").withColumn("cid", F.when(F.col("k") == 1, F.col("pc")).otherwise(new_id)), "kids")
        clusters = clusters.unionByName(kids.where("k > 1").select("cid", F.lit(1.0 / (level + 1)).alias("birth"), F.col("pc").alias("parent")))
        tree = kids.select("g", "cid")
        placed = cut(
            placed.join(tree.toDF("_g", "nc"), F.col(f"g{level}") == F.col("_g"), "left").select(
                *pts.columns, F.coalesce("nc", "cid").alias("cid"),
                F.when(F.col("nc").isNotNull(), F.lit(1.0 / level)).otherwise(F.col("lam")).alias("lam")), "placed")
    placed = cut(placed, "placed")
    clusters = cut(clusters, "clusters")
    owner = _select_clusters(clusters, placed, method, allow_single_cluster)
    mine = placed.where("cid is not null").join(owner, "cid").where("owner is not null")
    deaths = (
        placed.where("cid is not null").select("cid", "lam")
        .unionAll(clusters.where("parent is not null").select(F.col("parent").alias("cid"), F.col("birth").alias("lam")))
        .groupBy("cid").agg(F.max("lam").alias("death")))
    prob = mine.join(deaths.withColumnRenamed("cid", "owner"), "owner").select(
        "node_id", F.col("owner.n").alias("cluster_id"), (F.least("lam", "death") / F.col("death")).alias("probability"))
    return comps.join(prob, "node_id", "left").select("node_id", "component_id", "cluster_id", F.coalesce("probability", F.lit(0.0)).alias("probability"))


def _select_clusters(clusters: DataFrame, placed: DataFrame, method: str, allow_root: bool) -> DataFrame:
    """(cid, owner): the chosen cluster each condensed cluster belongs to, or null."""
    direct = placed.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n"), F.sum("lam").alias("sl"))
    # Sizes of child clusters are counted through all their descendants, level by level below.
    base = cut(clusters.join(direct, "cid", "left").select(
        "cid", "birth", "parent", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sl", F.lit(0.0)).alias("sl"), F.col("cid.l").alias("lvl")), "base")
    levels = [r["lvl"] for r in base.select("lvl").distinct().orderBy("lvl").collect()]  # one per hop level
    done = None
    for lvl in levels:
        here = base.where(F.col("lvl") == lvl)
        if done is None:
            kids = here.select("cid").where("false").select(F.col("cid").alias("parent"), F.lit(0).alias("kn"), F.lit(0.0).alias("kv"), F.lit(0.0).alias("kb"))
        else:
            kids = done.groupBy("parent").agg(F.sum("size").alias("kn"), F.sum("value").alias("kv"), F.sum(F.col("size") * F.col("birth")).alias("kb"))
        j = here.join(kids.withColumnRenamed("parent", "_p"), F.col("cid") == F.col("_p"), "left")
        size = F.col("n") + F.coalesce("kn", F.lit(0))
        stab = F.col("sl") + F.coalesce("kb", F.lit(0.0)) - size * F.col("birth")
        leaf = F.col("kn").isNull()
        barred = F.col("parent").isNull() & F.lit(not allow_root)
        below = F.coalesce("kv", F.lit(0.0))
        take = leaf if method == "leaf" else (leaf | (below <= stab))
        res = j.select("cid", "birth", "parent", size.alias("size"), stab.alias("stab"),
                       F.greatest(stab, below).alias("value"), (take & ~barred).alias("take"))
        done = cut(res if done is None else done.unionByName(res), "eom")
    if done is None:
        return base.select("cid", F.col("cid").alias("owner"))
    owner = None
    for lvl in reversed(levels):
        here = done.where(F.col("cid.l") == lvl)
        own = F.when(F.col("take"), F.col("cid"))
        if owner is None:
            res = here.select("cid", own.alias("owner"))
        else:
            res = here.join(owner.toDF("_c", "_o"), F.col("parent") == F.col("_c"), "left").select("cid", F.coalesce("_o", own).alias("owner"))
        owner = cut(res if owner is None else owner.unionAll(res), "owner")
    return owner
