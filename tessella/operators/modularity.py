"""Louvain communities in rounds of simultaneous moves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph, symmetric
from tessella.operators.small import NODES, apart, gathered, on_whole, stacks
from tessella.runtime import cut


def modularity(graph: Graph, communities: DataFrame, weight: str | None = None) -> float:
    """Modularity of ``communities(node_id, community_id)``."""
    e = graph.edges.select("u", "v", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return _quality(e, communities.select("node_id", F.col("community_id").alias("c")))


def _quality(e: DataFrame, comm: DataFrame) -> float:
    m = e.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return 0.0
    inner, squares = _parts(e, comm)
    return inner / m - squares / (4 * m * m)


def _parts(e: DataFrame, comm: DataFrame) -> tuple[float, float]:
    """Weight inside the communities, and the sum of their squared degrees."""
    ends = e.join(comm.toDF("u", "cu"), "u").join(comm.toDF("v", "cv"), "v")
    deg = ends.select(F.explode(F.array("cu", "cv")).alias("c"), F.col("w").alias("k"), F.when(F.col("cu") == F.col("cv"), F.col("w") / 2).alias("i"))
    both = deg.groupBy("c").agg(F.sum("k").alias("k"), F.sum("i").alias("i")).agg(F.sum("i"), F.sum(F.col("k") * F.col("k"))).first()
    return both[0] or 0.0, both[1] or 0.0


class _Rounds:
    """The rounds of a level over all nodes by joins."""

    def __init__(self, e: DataFrame, m: float, seed: int, resolution: float) -> None:
        self.e, self.m, self.seed, self.resolution = e, m, seed, resolution
        self.arcs = cut(symmetric(e.where("u <> v")), "arcs")
        loops = e.select(F.explode(F.array("u", "v")).alias("node_id"), "w")
        k = loops.groupBy("node_id").agg(F.sum("w").alias("k"))
        self.cur = cut(k.select("node_id", "k", F.col("node_id").alias("c")), "louvain")

    def step(self, r: int) -> tuple[float, float, int]:
        """Make the moves of round r; weight inside, squared degrees and the number of nodes that wish to move."""
        cur = self.cur
        tot = cur.groupBy("c").agg(F.sum("k").alias("tot"))
        kin = self.arcs.join(cur.select(F.col("node_id").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("node_id"), F.col("cb").alias("to")).agg(F.sum("w").alias("kin"))
        # The own community is always an option, even without an edge into it.
        opts = kin.unionAll(cur.select("node_id", F.col("c").alias("to"), F.lit(0.0).alias("kin"))).groupBy("node_id", "to").agg(F.sum("kin").alias("kin"))
        j = opts.join(cur, "node_id").join(tot.toDF("to", "tot"), "to")
        own = F.col("to") == F.col("c")
        gain = F.col("kin") - self.resolution * F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / (2 * self.m)
        pick = j.groupBy("node_id").agg(
            F.max(F.struct(F.round(gain, 12).alias("g"), own.alias("own"), F.xxhash64("to", F.lit(self.seed)).alias("t"), F.col("to"))).alias("p"))
        gate = F.pmod(F.xxhash64("node_id", F.lit(self.seed * 31 + r)), F.lit(2)) == 0
        nxt = cut(cur.join(pick, "node_id").select(
            "node_id", "k", F.when(gate, F.col("p.to")).otherwise(F.col("c")).alias("c"), (~F.col("p.own")).alias("wish")), "louvain")
        self.cur = nxt.select("node_id", "k", "c")
        return *_parts(self.e, self.cur.select("node_id", "c")), nxt.where("wish").count()


def _drawn(e: DataFrame, seed: int, rounds: int) -> DataFrame:
    """Edges with what the rounds draw for either end: the order of ties, and a bit for each round it may move in."""

    def gates(c: str):
        bits = F.lit(0).cast("long")
        for r in range(rounds):
            bits = bits.bitwiseOR(F.shiftleft((F.pmod(F.xxhash64(c, F.lit(seed * 31 + r)), F.lit(2)) == 0).cast("long"), r))
        return bits

    return e.select("component_id", "u", "v", "w", *[f(c) for c in ("u", "v") for f in (lambda c: F.xxhash64(c, F.lit(seed)), gates)])


def _small_rounds(component: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, tu: np.ndarray, gu: np.ndarray, tv: np.ndarray, gv: np.ndarray,
                  m: float, resolution: float, rounds: int, labels: bool) -> list:
    """Columns round, inner, squares, wishes of the rounds of whole components or, with ``labels``, node_id, c after them."""
    facts, found = np.zeros((3, rounds)), []
    for names, k, i, j, at in stacks(component, u, v):
        one = np.arange(names.shape[1])
        near, own_w, tie, gate = np.zeros((*names.shape, len(one))), np.zeros(names.shape), np.zeros(names.shape, np.int64), np.zeros(names.shape, np.int64)
        loop = i == j
        np.add.at(own_w, (k[loop], i[loop]), w[at][loop])
        k2, i2, j2, w2 = k[~loop], i[~loop], j[~loop], w[at][~loop]
        for a, b in ((i2, j2), (j2, i2)):
            np.add.at(near, (k2, a, b), w2)
        linked = np.zeros(near.shape)
        linked[k2, i2, j2] = linked[k2, j2, i2] = 1.0
        for a, t, g in ((i, tu, gu), (j, tv, gv)):
            tie[k, a], gate[k, a] = t[at], g[at]
        place = np.empty(names.shape, np.int64)  # of a community among those of equal gain
        np.put_along_axis(place, np.lexsort((names, tie), axis=1), np.broadcast_to(one, names.shape), axis=1)
        deg = near.sum(axis=2) + 2 * own_w
        c = np.broadcast_to(one, names.shape).copy()
        for r in range(rounds):
            member = (c[:, :, None] == one).astype(float)
            tot = (deg[:, :, None] * member).sum(axis=1)
            own = member > 0
            gain = near @ member - resolution * deg[:, :, None] * (tot[:, None, :] - np.where(own, deg[:, :, None], 0.0)) / (2 * m)
            gain = np.where((linked @ member > 0) | own, np.round(gain, 12), -np.inf)
            best = gain == gain.max(axis=2, keepdims=True)
            to = np.where(best, np.where(own, len(one), place[:, None, :]), -1).argmax(axis=2)
            wish = to != c
            c = np.where((gate >> r & 1) > 0, to, c)
            member = (c[:, :, None] == one).astype(float)
            tot = (deg[:, :, None] * member).sum(axis=1)
            inner = (near * (c[:, :, None] == c[:, None, :])).sum() / 2 + own_w.sum()
            state = np.array([inner, (tot * tot).sum(), wish.sum()])
            if not wish.any():  # no later round moves a node
                facts[:, r:] += state[:, None]
                break
            facts[:, r] += state
        if labels:
            found.append((names, np.take_along_axis(names, c, axis=1)))
    return gathered(found, [u.dtype, u.dtype]) if labels else [np.arange(rounds), *facts]


def _move(near: DataFrame | None, far: DataFrame | None, m: float, seed: int, max_rounds: int, resolution: float) -> tuple[DataFrame, float]:
    """(node_id, c) after local moves on the weighted edges, self-loops allowed, and its modularity.

    ``near`` has the edges (component_id, u, v, w) of small components, worked on as
    arrays, ``far`` all others (u, v, w); which round is best is told by both together.
    """
    facts = {}
    if near is not None:
        drawn = cut(_drawn(near, seed, max_rounds), "drawn")
        small = lambda rounds, labels, schema: on_whole(drawn, lambda *cols: _small_rounds(*cols, m, resolution, rounds, labels), schema)
        told = small(max_rounds, False, "round long, inner double, squares double, wishes double")
        facts = {r["round"]: r for r in told.groupBy("round").agg(F.sum("inner").alias("inner"), F.sum("squares").alias("squares"), F.sum("wishes").alias("wishes")).collect()}
    joins = None if far is None else _Rounds(far, m, seed, resolution)
    best_q, best, at, flat = None, None, 0, 0
    for r in range(max_rounds):
        inner, squares, wishes = (facts[r][k] for k in ("inner", "squares", "wishes")) if r in facts else (0.0, 0.0, 0)
        if joins:
            i, s, n = joins.step(r)
            inner, squares, wishes = inner + i, squares + s, wishes + n
        q = inner / m - squares / (4 * m * m)
        if best_q is None or q > best_q + 1e-7:
            best_q, best, at, flat = q, joins and joins.cur, r, 0
        else:
            flat += 1
        if wishes == 0 or flat >= 3:
            break
    moved = [] if best is None else [best.select("node_id", "c")]
    if near is not None:
        kind = near.schema["u"].dataType.simpleString()
        moved.append(small(at + 1, True, f"node_id {kind}, c {kind}"))
    return cut(moved[0] if len(moved) == 1 else moved[0].unionByName(moved[1]), "moved"), best_q


def louvain(graph: Graph, weight: str | None = None, seed: int = 42, resolution: float = 1.0, max_levels: int = 10, max_rounds: int = 20, small: int = NODES) -> DataFrame:
    """(node_id, community_id), the id being a member of the community.

    Nodes weigh all moves against the same state; a seeded half of them moves
    per round. Communities are merged into nodes and the moves repeated until
    the modularity stops rising. Communities stay within components: those of at
    most ``small`` nodes make all rounds of a level on arrays, many in a task.
    """
    e = cut(graph.edges.select("u", "v", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "edges")
    m = e.agg(F.sum("w")).first()[0] or 0.0
    label = cut(graph.vertices.select("node_id", F.col("node_id").alias("c")), "label")
    if not m:
        return label.select("node_id", F.col("c").alias("community_id"))
    near, far = apart(e, graph, "u", small if max_rounds <= 62 else 0)
    quality = _quality(e, label)
    for i in range(max_levels):
        moved, q = _move(near, far, m, seed + i, max_rounds, resolution)
        if q <= quality + 1e-7:
            break
        quality = q
        # a community without edges stays as it is
        label = cut(label.join(moved.toDF("c", "c2"), "c", "left").select("node_id", F.coalesce("c2", "c").alias("c")), "label")
        near, far = (x if x is None else _merged(x, moved) for x in (near, far))
    return label.select("node_id", F.col("c").alias("community_id"))


def _merged(level: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges with communities for nodes."""
    ends = level.join(moved.toDF("u", "cu"), "u").join(moved.toDF("v", "cv"), "v")
    keys = ["component_id"] if "component_id" in level.columns else []
    return cut(ends.groupBy(*keys, F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), "level")
