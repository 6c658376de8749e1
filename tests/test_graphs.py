"""Operators against hand-made graphs and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import betweenness as BC
from tessella.operators import blocks as BL
from tessella.operators import components as C
from tessella.operators import cores as CO
from tessella.operators import dataset as DS
from tessella.operators import density as DB
from tessella.operators import distances as D
from tessella.operators import flow as FL
from tessella.operators import local as LO
from tessella.operators import mcl as M
from tessella.operators import modularity as Q
from tessella.operators import seeds as S
from tessella.operators import spectral as SP
from tessella.operators.cliques import maximal_cliques
from tessella.plans.measures import compute_measures

PATH4 = [(1, 2), (2, 3), (3, 4)]
TRI_TAIL = [(1, 2), (2, 3), (1, 3), (3, 4)]
BARBELL = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
K5 = list(itertools.combinations(range(5), 2))


def table(df, key="node_id"):
    value = [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def groups(df, key, node="node_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[node])
    return sorted(map(sorted, out.values()))


def test_components_on_a_long_path_and_star(make):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = table(C.connected_components(make(pairs, nodes=[500])))
    assert set(got.values()) == {0, 100, 500} and got[40] == 0 and got[129] == 100


def test_local_measures(make):
    g = make(TRI_TAIL + [(3, 3)])
    assert table(LO.triangles(g)) == {1: 1, 2: 1, 3: 1, 4: 0}
    assert LO.transitivity(g).first()[0] == 0.6
    assert table(LO.local_clustering(g)) == {1: 1.0, 2: 1.0, 3: pytest.approx(1 / 3), 4: 0.0}


def test_path_measures(make):
    g = make(PATH4)
    assert table(D.harmonic(g)) == {1: pytest.approx(11 / 6), 2: 2.5, 3: 2.5, 4: pytest.approx(11 / 6)}
    assert table(D.mean_distance_per_node(g))[1] == 2.0
    deps = BC.dependencies(g)
    assert table(BC.betweenness(g, deps=deps)) == {1: 0, 2: 2, 3: 2, 4: 0}
    assert {(r.u, r.v): r.edge_betweenness for r in BC.edge_betweenness(g, deps=deps).collect()} == {(1, 2): 3, (2, 3): 4, (3, 4): 3}


def test_blocks(make):
    g = make(BARBELL)
    b = BL.blocks(g)
    assert sorted(r["count"] for r in b.groupBy("block_id").count().collect()) == [1, 3, 3]
    assert [(r.u, r.v) for r in BL.bridges(g, b).collect()] == [(3, 4)]
    assert {k for k, f in table(BL.articulation_points(g, b)).items() if f} == {3, 4}


def test_cores_and_truss(make):
    g = make(K5 + [(4, 9), (9, 10)])
    assert table(CO.core_numbers(g)) == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 9: 1, 10: 1}
    assert {r.k: r.n_nodes for r in CO.truss_sizes(g).collect()} == {3: 5, 4: 5, 5: 5}
    density, members = CO.densest_peel(g)
    assert density == 2.0 and {r.node_id for r in members.collect()} == set(range(5))


def test_maximal_cliques_match_brute_force(make):
    pairs = random_graph(14, 45, 3)
    near = neighbours(pairs)
    want = set()
    nodes = sorted(near)
    for k in range(2, 8):
        for c in itertools.combinations(nodes, k):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(all(x in near[a] for a in c) for x in nodes if x not in c):
                want.add(c)
    assert {tuple(r.members) for r in maximal_cliques(make(pairs)).collect()} == want


def test_flow_dense_and_iterative_agree(make):
    g = make(BARBELL + [(10, 11), (11, 12)])
    a = {r.node_id: (r.flow_closeness, r.flow_betweenness) for r in FL.flow_measures(g).collect()}
    b = {r.node_id: (r.flow_closeness, r.flow_betweenness) for r in FL.flow_measures(g, dense_nodes=0).collect()}
    assert a[11][1] == pytest.approx(1.0) and a[11][0] == pytest.approx(0.5)
    for n in a:
        assert a[n] == pytest.approx(b[n], abs=1e-7)


def test_spectrum(make):
    assert SP.spectral_radius(make(K5), None) == pytest.approx(4.0)
    lap = np.zeros((6, 6))
    for a, b in BARBELL:
        lap[a - 1, b - 1] = lap[b - 1, a - 1] = -1
    lap -= np.diag(lap.sum(axis=1))
    assert SP.algebraic_connectivity(make(BARBELL)) == pytest.approx(np.linalg.eigvalsh(lap)[1], abs=1e-7)
    assert SP.algebraic_connectivity(make(PATH4 + [(8, 9)])) == 0.0


def test_mcl_closed_form_cuts_between_hubs(make):
    star = [(0, i) for i in range(1, 11)] + [(20, 20 + i) for i in range(1, 11)] + [(0, 20)]
    got = groups(M.markov_clusters(make(star), expansion=5, inflation=3, prune=0.11).clusters, "cluster_id")
    assert got == [list(range(11)), list(range(20, 31))]


def _mcl_dense(pairs, n, e, r, t):
    m = np.eye(n)
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    m /= m.sum(axis=0)
    for _ in range(200):
        prev = m
        m = (m @ m if e == 2 else m ** e) ** r
        s = m.sum(axis=0)
        s[s == 0] = 1
        m = m / s
        m[m < t] = 0
        if np.linalg.norm(m - prev) < 1e-6:
            break
    return m


@pytest.mark.parametrize("e,r,t", [(2, 2, 0.01), (3, 2, 0.23)])
def test_mcl_matrix_matches_dense(make, e, r, t):
    pairs = BARBELL + [(6, 0)]
    want = _mcl_dense(pairs, 7, e, r, t)
    got = np.zeros((7, 7))
    for x in M.markov_matrix(make(pairs), expansion=e, inflation=r, prune=t).collect():
        got[x["row"], x["col"]] = x["val"]
    assert np.allclose(got, want, atol=1e-6)


def _dbscan(pairs, eps, k):
    near = neighbours(pairs)
    ball = {}
    for n in near:
        seen, layer = {n}, {n}
        for _ in range(eps):
            layer = {y for x in layer for y in near[x]} - seen
            seen |= layer
        ball[n] = seen
    core = {n for n in near if len(ball[n]) >= k}
    label = {}
    for n in sorted(core):
        if n in label:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = n
                todo += [y for y in ball[x] if y in core]
    return {n: label[n] if n in core else min((label[y] for y in ball[n] if y in core), default=None) for n in near}


@pytest.mark.parametrize("eps,k", [(1, 4), (2, 6), (3, 9)])
def test_dbscan_matches_brute_force(make, eps, k):
    pairs = random_graph(40, 44, 11)
    assert table(DB.dbscan(make(pairs), eps, k).select("node_id", "cluster_id")) == _dbscan(pairs, eps, k)


def test_hdbscan_finds_two_dense_ends(make):
    # Two cliques joined through degree-one-like chains of hops.
    left, right = list(itertools.combinations(range(6), 2)), list(itertools.combinations(range(20, 26), 2))
    g = make(left + right + [(5, 10), (10, 11), (11, 20)])
    got = DB.hdbscan(g, min_cluster_size=5, min_samples=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.cluster_id, set()).add(r.node_id)
    assert set(range(6)) in by.values() and set(range(20, 26)) in by.values()


def test_dpclus_paths_agree(make):
    g = make(random_graph(18, 60, 5))
    one = {(r.cluster_id, r.node_id) for r in S.dpclus(g).collect()}
    assert one == {(r.cluster_id, r.node_id) for r in S.dpclus(g, unit_edges=0).collect()}
    assert sorted(n for _, n in one) == sorted(r.node_id for r in g.vertices.collect())


def _eagle(pairs, dmin, pmin, thr):
    near = neighbours(pairs)

    def inner(s):
        return sum(1 for a, b in pairs if a in s and b in s)

    def dens(s):
        return inner(s) / (len(s) * (len(s) - 1) / 2) if len(s) > 1 else 0.0

    w = {n: dens({n} | near[n]) * len(near[n]) for n in near}
    free, out = set(near), []
    while free:
        seed = min(free, key=lambda n: (-w[n], n))
        got, todo = {seed}, [seed]
        free.remove(seed)
        while todo:
            for y in near[todo.pop()]:
                if y in free and w[y] >= w[seed] * thr:
                    free.remove(y)
                    got.add(y)
                    todo.append(y)
        if dens(got) < dmin:
            continue
        while True:
            gone = {n for n in got if len(near[n] & got) / len(near[n]) < pmin}
            got -= gone
            if not gone or len(got) < 2:
                break
        if len(got) >= 2 and dens(got) >= dmin:
            out.append(sorted(got))
    return sorted(out)


@pytest.mark.parametrize("thr", [1.0, 0.6])
def test_eagle_matches_brute_force(make, thr):
    pairs = random_graph(16, 34, 8)
    assert groups(S.eagle(make(pairs), 0.2, 0.3, thr), "cluster_id") == _eagle(pairs, 0.2, 0.3, thr)


def test_communities(make):
    g = make(BARBELL)
    lv = Q.louvain(g)
    assert Q.modularity(g, lv) > 0.3
    assert groups(lv, "community_id") == [[1, 2, 3], [4, 5, 6]]
    cd = S.boundary_communities(g)
    assert groups(cd, "community_id") == [[1, 2, 3], [4, 5, 6]]


def test_unknown_measure_is_refused(make):
    with pytest.raises(ValueError):
        compute_measures(make(PATH4), ["degree", "nope"])


def test_weighted_assortativity_inputs(make):
    g = make(PATH4)
    v = g.vertices.withColumn("x", F.col("node_id"))
    from tessella.graph import Graph

    assert LO.numeric_assortativity(Graph(v, g.edges), "x").first()[0] == pytest.approx(np.corrcoef([1, 2, 3, 2, 3, 4], [2, 3, 4, 1, 2, 3])[0, 1])


def test_gml_with_nested_records(spark, tmp_path):
    from tessella.sources.graphs import read_gml

    (tmp_path / "g.gml").write_text(
        'graph [ directed 0 node [ id 1 label "a [edge [ x" graphics [ x 1 fill [ c 2 ] ] ] node [ id 2 ] node [ id 3 graphics [ y 2 ] ]'
        " edge [ source 1 graphics [ width 2 ] target 2 value 1.5 ] edge [ source 2 target 3 graphics [ id 9 ] ] ]")
    g = read_gml(spark, f"file://{tmp_path}/g.gml")
    assert sorted(r.node_id for r in g.vertices.collect()) == [1, 2, 3]
    assert sorted((r.u, r.v, r.weight) for r in g.edges.collect()) == [(1, 2, 1.5), (2, 3, 1.0)]


def test_attribute_assortativity_in_the_registry(spark, make):
    from tessella.graph import Graph
    from tessella.plans.measures import compute_measures

    g = make([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    att = spark.createDataFrame([(i, i % 2, "xy"[i // 2]) for i in range(4)], "node_id long, n int, k string")
    out = compute_measures(Graph(g.vertices.join(att, "node_id"), g.edges), ["att_assortativity"], {"n": "numeric", "k": "categorical"})
    assert {r.attribute for r in out["att_assortativity"].collect()} == {"n", "k"}


def test_balls_write_no_pairs(make, monkeypatch):
    """Sets travel as arrays: no table written has a row per (anchor, node)."""
    pairs = list(itertools.combinations(range(30), 2)) + [(i, i + 1) for i in range(29, 60)]
    g = make(pairs)
    g = Graph(g.vertices.withColumn("is_mut", F.when(F.col("node_id") != 45, 1).otherwise(0)), g.edges)
    rows, write = [], DS.cut

    def counted(df, label="cut"):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(DS, "cut", counted)
    got = groups(DS.anchored_balls(g, ratio=1.0, max_size=20, min_component=10), "anchor")
    near = neighbours(pairs)

    def ball(n):
        held = {n}
        for _ in range(3):
            held |= {m for x in held for m in near[x]}
        return sorted(held)

    assert got == sorted(b for b in (ball(n) for n in near if n != 45) if 4 <= len(b) <= 20)
    assert max(rows) <= 2 * len(pairs)


def test_balls_of_single_nodes(make):
    g = make([(1, 2), (2, 3), (2, 2)], nodes=[9])
    g = Graph(g.vertices.withColumn("is_mut", F.lit(1)), g.edges)
    got = DS.anchored_balls(g, ratio=1.0, min_size=1, max_size=2, min_component=1).collect()
    assert [(r.component_id, r.anchor, r.node_id) for r in got] == [(9, 9, 9)]


def test_near_ids_need_no_rounds(make, monkeypatch):
    """Components within a stretch are joined there; only what meets across stretches goes through rounds."""
    asked, rounds = [], C._star_rounds

    def counted(edges, max_rounds):
        asked.append(edges.count())
        return rounds(edges, max_rounds)

    monkeypatch.setattr(C, "_star_rounds", counted)
    pairs = [(10 * c + i, 10 * c + i + 1) for c in range(400) for i in range(6)] + [(3, 3990), (13, 2000)]
    got = table(C.connected_components(make(pairs, nodes=[5000])))
    want = {n: 10 * (n // 10) for p in pairs for n in p} | {5000: 5000}
    want |= {3990 + i: 0 for i in range(7)} | {2000 + i: 10 for i in range(7)}
    assert got == want and sum(asked) < 50


def test_small_components_are_searched_without_rounds(make, monkeypatch):
    pairs = [(0, i) for i in range(1, 64)] + [(100 + a, 100 + b) for a, b in random_graph(40, 60, 3)] + [(900, 901), (901, 902), (902, 900)]
    far = [(1000 + i, 1001 + i) for i in range(70)]
    g, both = make(pairs), make(pairs + far)
    searched, search = [], D._search

    def counted(start, *rest):
        searched.append(start.count())
        return search(start, *rest)

    monkeypatch.setattr(D, "_search", counted)

    def brute(edges, bound):
        near, out = neighbours(edges), {}
        for s in near:
            level, seen, d = {s}, {s}, 0
            while level and d < bound:
                level, d = {m for x in level for m in near[x]} - seen, d + 1
                seen |= level
                if level:
                    out[s, d] = len(level)
        return out

    for graph, edges, bound in ((g, pairs, None), (both, pairs + far, 5)):
        got = D.distance_profile(graph, bound).collect()
        assert len(got) == len({(r.node_id, r.d) for r in got}) and {(r.node_id, r.d): r.n for r in got} == brute(edges, bound or 99)
    assert sum(searched) == 71


def test_cores_are_linked_by_their_own_ids(make, monkeypatch):
    """The groups of cores come from links between cores, not from a graph of (layer, node)."""
    seen, edges = [], DB.component_edges

    def kept(e, *rest):
        seen.append(e)
        return edges(e, *rest)

    monkeypatch.setattr(DB, "component_edges", kept)
    pairs = [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (5, 6), (5, 7), (5, 8)]
    got = {(r.node_id, r.cluster_id, r.core) for r in DB.dbscan(make(pairs, nodes=[20]), 2, 6).collect()}
    assert got == {(0, 3, False), (1, 3, False), (2, 3, False), (3, 3, True), (4, 3, True), (5, 3, True), (6, 3, False), (7, 3, False), (8, 3, False), (20, None, False)}
    assert {x for e in seen for r in e.collect() for x in (r.u, r.v)} <= {3, 4, 5}


def test_components_of_strings_are_joined_in_stretches(spark, monkeypatch):
    from tessella.operators import components as C

    r, n = random.Random(9), 300
    pairs = [tuple(r.sample(range(n), 2)) for _ in range(260)]
    name = lambda k: f"{'é' if k % 7 == 0 else 'z' if k % 3 else 'Z'}{k}"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs] + [(name(1), name(1))], "u string, v string").repartition(3)
    root = {k: k for k in range(n)}
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for a in {x for p in pairs for x in p}:
        groups.setdefault(root[a], []).append(name(a))
    want = {(min(g, key=str.encode), x) for g in groups.values() for x in g if x != min(g, key=str.encode)}
    seen = []
    monkeypatch.setattr(C, "_star_rounds", lambda e, k, f=C._star_rounds: seen.append(e.count()) or f(e, k))
    got = {(e.u, e.v) for e in C.component_edges(edges).collect()}
    assert got == want and max(seen, default=0) < len(pairs) / 2


def test_pajek_in_several_files(spark, tmp_path, make):
    from tessella.sources.graphs import read_pajek, write_pajek

    pairs = [(k, k + 1) for k in range(0, 90, 3)]
    g = make(pairs, nodes=(999,), weights=[k / 4 for k in range(30)])
    write_pajek(g, str(tmp_path / "net"), lines=20)
    files = sorted((tmp_path / "net").glob("part-*"))
    assert len(files) > 2 and all(f.read_text().count("*Edges") for f in files if f.stat().st_size)
    back = read_pajek(spark, str(tmp_path / "net"))
    number = lambda df: sorted((float(r.weight), *sorted((int(r.u), int(r.v)))) for r in df.collect())
    assert number(back.edges) == number(g.edges)
    assert {int(r.node_id) for r in back.vertices.collect()} == {r.node_id for r in g.vertices.collect()}
