"""Components of few nodes on arrays give what the rounds give."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import betweenness as BC
from tessella.operators import blocks as BL
from tessella.operators import distances as D
from tessella.operators import flow as FL
from tessella.operators import seeds as S
from tessella.operators import weighted as W
from tessella.operators.cliques import maximal_cliques
from tessella.operators.small import on_whole, parted


def clumps(seed, n=25, size=9):
    """Random groups of nodes side by side, some of them in several parts."""
    rng = random.Random(seed)
    out = set()
    for k in range(n):
        m = rng.randint(2, size)
        for _ in range(rng.randint(1, 2 * m)):
            a, b = rng.sample(range(m), 2)
            out.add((100 * k + min(a, b), 100 * k + max(a, b)))
    return sorted(out)


def rows(df, *key):
    return {tuple(r[k] for k in key): [x for c, x in r.asDict().items() if c not in key] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-7), k


def test_all_rows_of_a_key_come_together(spark, monkeypatch):
    from tessella.operators import small

    monkeypatch.setattr(small, "STRETCH", 7)
    t = spark.range(1000).select((F.col("id") % 90).alias("k"), F.col("id").alias("x"))

    def count(k, x):
        import numpy as np

        assert (np.diff(k) >= 0).all()
        keys, n = np.unique(k, return_counts=True)
        return [keys, n]

    got = on_whole(t, count, "k long, n long").collect()
    assert sorted((r.k, r.n) for r in got) == [(k, 12 if k < 10 else 11) for k in range(90)]
    words = on_whole(t.select(F.concat(F.lit("w"), "k").alias("k"), "x"), lambda k, x: [k, x], "k string, x long").collect()
    assert sorted((r.k, r.x) for r in words) == sorted((f"w{i % 90}", i) for i in range(1000))


def test_parts_cover_the_graph(make):
    pairs = clumps(1) + [(9000 + i, 9001 + i) for i in range(80)]
    near, rest = parted(make(pairs + [(5, 5)], nodes=[77777]))
    a, b = [(r.u, r.v) for r in near.collect()], [(r.u, r.v) for r in rest.edges.collect()]
    assert sorted(a + b) == pairs and len(b) == 80
    assert sorted(r.node_id for r in rest.vertices.collect()) == [9000 + i for i in range(81)]


def test_weighted_means_on_arrays(make):
    pairs = clumps(2, 12)
    rng = random.Random(2)
    weights = [rng.choice([-3, 0, 1, 2.5, 7, float("nan"), float("inf")]) for _ in pairs]
    g = make(pairs, nodes=[77777], weights=weights)
    near = {n: {} for n in [77777, *{x for p in pairs for x in p}]}
    for (a, b), w in zip(pairs, weights):
        if w == w:
            near[a][b] = near[b][a] = abs(w)
    want = {}
    for n in near:
        d, todo = {n: 0.0}, [n]
        while todo:
            x = todo.pop(0)
            for y, w in near[x].items():
                if y not in d or d[x] + w < d[y]:
                    d[y] = d[x] + w
                    todo.append(y)
        want[(n,)] = [-sum(d.values()) / (len(d) - 1) if len(d) > 1 else 0.0]
    close(rows(W.mean_weighted_distance(g), "node_id"), want)


def test_betweenness_on_arrays(make):
    g = make(clumps(3, 6, 6), nodes=[77777])
    want = rows(BC.dependencies(g, small_nodes=0), "v", "w")
    for bound in (64, 4):
        close(rows(BC.dependencies(g, small_nodes=bound), "v", "w"), want)


def test_current_flow_on_arrays(make):
    g = make(clumps(4, 12), nodes=[77777])
    want = FL.flow_measures(g, small_nodes=0).where("flow_closeness is not null")
    got = FL.flow_measures(g)
    close(rows(got.where("flow_closeness is not null"), "node_id"), rows(want, "node_id"))
    assert rows(got, "node_id")[(77777,)] == [None, 0.0]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    close(rows(FL.flow_measures(g, small_nodes=4).where("flow_closeness is not null"), "node_id"), rows(want, "node_id"))


def test_blocks_on_arrays(make):
    g = make(clumps(5, 20, 7), nodes=[77777])
    want = rows(BL.blocks(g, small_nodes=0), "u", "v")
    assert rows(BL.blocks(g), "u", "v") == want
    assert rows(BL.blocks(g, small_nodes=4), "u", "v") == want


def test_local_efficiency_on_arrays(make):
    g = make(clumps(6, 8, 9), nodes=[77777])
    want = D.local_efficiency(g, small_nodes=0).first()[0]
    assert want > 0
    assert D.local_efficiency(g).first()[0] == pytest.approx(want)


def test_units_and_centres_share_tasks(make):
    g = make(clumps(7, 8, 6))
    for df in (S.dpclus(g), maximal_cliques(g)):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    close(rows(S.dpclus(g), "node_id"), rows(S.dpclus(g, unit_edges=0), "node_id"))


def test_settled_components_leave_the_rounds(make, monkeypatch):
    seen, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, label="cut": (out := cut(df, label), seen.append(out) if label == "arcs" else None)[0])
    g = make([(100 * k + a, 100 * k + b) for k in range(6) for a, b in [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)]])
    out = S.boundary_communities(g)
    assert out.count() == 30 and out.select("node_id").distinct().count() == 30
    sizes = [x.count() for x in seen]
    assert sizes[0] == 72 and len(sizes) > 1 and sizes[-1] < 72


def test_matrix_products_of_small_components(spark, make):
    from tessella.operators import mcl as M

    g = make([*clumps(5, 12, 7), (0, 0), (9000, 9000)], nodes=(9999,))
    params = {"expansion": 2, "inflation": 2, "prune": 0.05}
    want = rows(M.markov_matrix(g, **params, small=0).where("val > 0"), "row", "col")
    close(rows(M.markov_matrix(g, **params, small=5).where("val > 0"), "row", "col"), want)  # some by joins
    with pytest.raises(RuntimeError):
        M.markov_matrix(g, **params, max_iter=2)


def test_communities_of_small_components(spark, make):
    from tessella.operators import modularity as Q

    pairs = clumps(6, 8) + [(8000, 8000)]
    g = make(pairs, nodes=(9999,), weights=[1 + (a * 7 + b) % 3 for a, b in pairs])
    want = rows(Q.louvain(g, "weight", small=0, max_levels=2, max_rounds=3), "node_id")
    assert rows(Q.louvain(g, "weight", small=5, max_levels=2, max_rounds=3), "node_id") == want
