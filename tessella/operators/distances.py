"""Shortest-path measures from bit-parallel breadth-first search.

Every node is a source. Sources are numbered so that those of one component
share 64-bit words; a row (node, word, mask) then says which of 64 sources have
just reached the node. One round is a join with the edges and a bit-or
aggregate, so 64 searches cost one row and no (source, target) pair is written.
In an undirected graph the neighbours of level d lie on levels d-1, d and d+1,
so two levels are all the state a round needs.

A component of at most 64 nodes needs one word only: its edges are brought
together and the same search runs on arrays, many components at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph, symmetric
from tessella.operators.components import connected_components
from tessella.operators.small import on_whole
from tessella.runtime import cut, no_rows

# Rows of search state worked on at a time; more sources are done in batches.
STATE_ROWS = 2_000_000_000
# Nodes of a component up to which its searches are done in one task: the bits of a word.
WORD = 64


def _slots(components: DataFrame) -> DataFrame:
    """(node_id, word, mask): a private bit for every source.

    Consecutive ids within a range partition give the bit and the word, so no
    global numbering is needed.
    """
    placed = components.repartitionByRange("component_id", "node_id").sortWithinPartitions("component_id", "node_id")
    k = placed.withColumn("_k", F.monotonically_increasing_id())
    return cut(
        k.select("node_id", "component_id", F.expr("_k div 64").alias("word"), F.expr("shiftleft(1L, cast(_k % 64 as int))").alias("mask")),
        "slots",
    )


def _batches(slots: DataFrame) -> int:
    """Batches of words that keep the state within STATE_ROWS."""
    per = slots.groupBy("component_id").agg(F.count("*").alias("n"), F.count_distinct("word").alias("w"))
    rows = per.agg(F.sum(F.col("n") * F.col("w"))).first()[0] or 0
    return max(1, -(-rows // STATE_ROWS))


def _search(start: DataFrame, sym: DataFrame, max_d: int | None) -> list[DataFrame]:
    """Per distance d >= 1, the rows (node_id, word, mask) first reached at d."""
    arcs = sym.select("a", F.col("b").alias("_to"))
    prev = start.limit(0)
    cur, levels = start, []
    while max_d is None or len(levels) < max_d:
        reach = cur.join(arcs, cur["node_id"] == arcs["a"]).select(
            F.col("_to").alias("node_id"), "word", F.col("mask").alias("r"), F.lit(0).cast("long").alias("o")
        )
        old = cur.unionAll(prev).select("node_id", "word", F.lit(0).cast("long").alias("r"), F.col("mask").alias("o"))
        new = (
            reach.unionAll(old).groupBy("node_id", "word").agg(F.bit_or("r").alias("r"), F.bit_or("o").alias("o"))
            .select("node_id", "word", F.expr("r & ~o").alias("mask")).where("mask <> 0")
        )
        new = cut(new, "level")
        if no_rows(new):
            break
        levels.append(new)
        prev, cur = cur, new
    return levels


def _levels(component: np.ndarray, u: np.ndarray, v: np.ndarray, max_d: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (node, d, n) of whole components of at most 64 nodes, given as edges."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u):]
    home = np.empty(len(names), component.dtype)
    home[i] = home[j] = component
    order = np.argsort(home, kind="stable")
    _, first, size = np.unique(home[order], return_index=True, return_counts=True)
    slot = np.empty(len(names), np.uint64)
    slot[order] = np.arange(len(names)) - np.repeat(first, size)
    seen = np.left_shift(np.uint64(1), slot)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.argsort(b, kind="stable")
    a, starts = a[by], np.searchsorted(b[by], np.arange(len(names)))
    cur, out, d = seen, [], 0
    while max_d is None or d < max_d:
        new = np.bitwise_or.reduceat(cur[a], starts) & ~seen
        hit = np.flatnonzero(new)
        if not len(hit):
            break
        d += 1
        out.append((names[hit], np.full(len(hit), d, np.int32), np.bitwise_count(new[hit]).astype(np.int64)))
        seen, cur = seen | new, new
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (names[:0], np.empty(0, np.int32), np.empty(0, np.int64))


def _local_profile(edges: DataFrame, max_d: int | None) -> DataFrame:
    """(node_id, d, n) from ``edges(component_id, u, v)`` of components of at most 64 nodes, ids being whole numbers."""
    kind = edges.schema["u"].dataType.simpleString()
    return on_whole(edges.select("component_id", "u", "v"), lambda c, u, v: list(_levels(c, u, v, max_d)), f"node_id {kind}, d int, n long")


def distance_profile(graph: Graph, max_d: int | None = None, components: DataFrame | None = None) -> DataFrame:
    """(node_id, d, n): how many other nodes lie at each distance d >= 1 (up to max_d).

    The ends of all edges are vertices. Components of more than 64 nodes, and
    nodes that are not whole numbers, are searched in rounds.
    """
    comps = components if components is not None else connected_components(graph)
    edges = graph.edges.where("u <> v").select("u", "v")
    local = None
    if comps.schema["node_id"].dataType.simpleString() in ("bigint", "int"):
        comps = cut(comps, "comps") if components is None else comps
        sizes = cut(comps.groupBy("component_id").agg(F.count("*").alias("size")), "sizes")
        far = cut(sizes.where(F.col("size") > WORD).select("component_id"), "far")
        none = no_rows(far)
        near = comps if none else comps.join(far, "component_id", "left_anti")
        local = _local_profile(edges.join(near.select(F.col("node_id").alias("u"), "component_id"), "u").select("component_id", "u", "v"), max_d)
        if none:
            return cut(local, "profile")
        comps = comps.join(far, "component_id", "left_semi")
    slots = _slots(comps)
    sym = cut(symmetric(edges).select("a", "b"), "sym")
    parts = [] if local is None else [local.select("node_id", "d", F.col("n").alias("c"))]
    batches = _batches(slots)
    for i in range(batches):
        start = slots.where(F.pmod("word", F.lit(batches)) == i).select("node_id", "word", "mask")
        for d, level in enumerate(_search(start, sym, max_d), 1):
            parts.append(level.select("node_id", F.lit(d).alias("d"), F.bit_count("mask").cast("long").alias("c")))
    if not parts:
        return graph.vertices.select("node_id", F.lit(1).alias("d"), F.lit(0).cast("long").alias("n")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return cut(out.groupBy("node_id", "d").agg(F.sum("c").alias("n")), "profile")


def _over_vertices(graph: Graph, per: DataFrame, column: str) -> DataFrame:
    return graph.vertices.select("node_id").join(per, "node_id", "left").select(
        "node_id", F.coalesce(column, F.lit(0.0)).alias(column)
    )


def harmonic(graph: Graph, profile: DataFrame | None = None) -> DataFrame:
    """(node_id, closeness_centrality): sum of 1/d over reachable nodes, not normalised."""
    p = profile if profile is not None else distance_profile(graph)
    per = p.groupBy("node_id").agg(F.sum(F.col("n") / F.col("d")).alias("closeness_centrality"))
    return _over_vertices(graph, per, "closeness_centrality")


def mean_distance_per_node(graph: Graph, profile: DataFrame | None = None) -> DataFrame:
    """(node_id, shortest_path_length): sum of reachable distances / (N - 1) over the whole graph."""
    p = profile if profile is not None else distance_profile(graph)
    n = graph.vertices.count()
    per = p.groupBy("node_id").agg((F.sum(F.col("n") * F.col("d")) / max(n - 1, 1)).alias("shortest_path_length"))
    return _over_vertices(graph, per, "shortest_path_length")


def mean_distance_per_component(graph: Graph) -> DataFrame:
    """(component_id, n_nodes, avg_short_path_len); one row if the graph is connected."""
    comps = cut(connected_components(graph), "comps")
    p = distance_profile(graph, components=comps)
    total = p.join(comps, "node_id").groupBy("component_id").agg(F.sum(F.col("n") * F.col("d")).alias("s"))
    sizes = comps.groupBy("component_id").agg(F.count("*").alias("n_nodes"))
    n = F.col("n_nodes")
    value = F.when(n < 2, 0.0).otherwise(F.coalesce("s", F.lit(0)) / (n * (n - 1)))
    return sizes.join(total, "component_id", "left").select("component_id", "n_nodes", value.alias("avg_short_path_len"))


def global_efficiency(graph: Graph, profile: DataFrame | None = None) -> DataFrame:
    """One row: mean of 1/d over ordered node pairs, 0 for unreachable pairs."""
    n = graph.vertices.count()
    h = harmonic(graph, profile).agg(F.sum("closeness_centrality").alias("s"))
    return h.select((F.col("s") / (n * (n - 1)) if n > 1 else F.lit(0.0)).alias("global_efficiency"))


def _ego_closeness(c: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Columns node_id, h: the summed closeness in the neighbourhood of every centre, from its whole list of links (c, u, v)."""
    centres, at = np.unique(c, return_inverse=True)
    names, to = np.unique(np.concatenate([u, v]), return_inverse=True)
    # a neighbour is a node of its own at every centre
    x, d, n = _levels(at, at * len(names) + to[: len(u)], at * len(names) + to[len(u):], None)
    return [centres, np.bincount(x // len(names), n / d, len(centres))]


def local_efficiency(graph: Graph, small_nodes: int = WORD) -> DataFrame:
    """One row: mean over nodes of the efficiency of the subgraph of their neighbours.

    Neighbourhoods of at most ``small_nodes`` (up to 64) nodes that are whole
    numbers are searched on arrays. The others are laid side by side as one graph whose nodes
    are (centre, neighbour) and whose edges are the triangles at the centre.
    """
    from tessella.operators.local import triangle_list

    t = cut(triangle_list(graph), "triangles")
    degrees = cut(graph.degrees(), "degrees")

    def at(centre: str, x: str, y: str):
        return F.struct(F.col(centre).alias("c"), F.col(x).alias("u"), F.col(y).alias("v"))

    links = t.select(F.explode(F.array(at("a", "b", "c"), at("b", "a", "c"), at("c", "a", "b"))).alias("e")).select("e.*")
    kind = graph.vertices.schema["node_id"].dataType.simpleString()
    most = min(small_nodes, WORD) if kind in ("bigint", "int") else 0
    hubs = cut(degrees.where(F.col("deg") > most).select(F.col("node_id").alias("c")), "hubs")
    none = most > 0 and no_rows(hubs)
    per = on_whole(links if none else links.join(hubs, "c", "left_anti"), _ego_closeness, f"node_id {kind}, h double") if most else None
    if not none:
        def of(x):
            return F.struct(F.col("c"), x.alias("n"))

        egos = Graph.from_edges(links.join(hubs, "c", "left_semi").select(of(F.least("u", "v")).alias("u"), of(F.greatest("u", "v")).alias("v")))
        far = harmonic(egos).groupBy(F.col("node_id.c").alias("node_id")).agg(F.sum("closeness_centrality").alias("h"))
        per = far if per is None else per.unionAll(far)
    n = graph.vertices.count()
    d = F.col("deg")
    eff = per.join(degrees, "node_id").select((F.col("h") / (d * (d - 1))).alias("x"))
    return eff.agg((F.coalesce(F.sum("x"), F.lit(0.0)) / max(n, 1)).alias("local_efficiency"))


def pairs_within(graph: Graph, bound: int) -> DataFrame:
    """(src, dst, d) for 0 <= d <= bound, the bounded form of the all-pairs table."""
    sym = cut(graph.sym().select("a", F.col("b").alias("_to")), "sym")
    level = graph.vertices.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("d"))
    prev, cur, levels = level.limit(0), cut(level, "pairs"), []
    levels.append(cur)
    for d in range(1, bound + 1):
        step = cur.join(sym, cur["dst"] == sym["a"]).select("src", F.col("_to").alias("dst")).distinct()
        seen = cur.unionAll(prev).select("src", "dst")
        nxt = cut(step.join(seen, ["src", "dst"], "left_anti").select("src", "dst", F.lit(d).alias("d")), "pairs")
        levels.append(nxt)
        prev, cur = cur, nxt
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def graph_fingerprint(graph: Graph) -> DataFrame:
    """One row (edges, mark) that names a graph, e.g. as the key of a stored distance table."""
    return graph.edges.agg(F.count("*").alias("edges"), F.bit_xor(F.xxhash64("u", "v")).alias("mark"))
