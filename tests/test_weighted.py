"""Weighted shortest paths against a search with a heap."""

import heapq
import math
import random

import pytest

from tessella.graph import Graph
from tessella.operators.weighted import mean_weighted_distance, weighted_distances
from tessella.plans.measures import compute_measures


def searched(edges, src):
    near = {}
    for u, v, w in edges:
        if w is not None and not math.isnan(w):
            near.setdefault(u, []).append((v, abs(w)))
            near.setdefault(v, []).append((u, abs(w)))
    best, heap = {}, [(0.0, src)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, w in near.get(n, ()):
                heapq.heappush(heap, (d + w, m))
    return best


def hub_and_chain(seed):
    """A hub with 60 leaves, shortcuts between them, a chain with heavy edges, an edge apart and one without weight."""
    rng = random.Random(seed)
    edges = {(0, i): rng.randint(-9, 9) for i in range(1, 61)}
    edges |= {tuple(sorted(rng.sample(range(1, 61), 2))): rng.randint(0, 4) for _ in range(90)}
    edges |= {(i, i + 1): rng.choice([-40, 1, 25]) for i in range(60, 72)}
    edges |= {(200, 201): 3, (201, 202): None, (203, 203): 1, (204, 205): 0}
    return [(u, v, None if w is None else float(w)) for (u, v), w in edges.items()]


@pytest.mark.parametrize("delta", [None, 7.0, 1000.0])
def test_distances_equal_a_heap_search(spark, delta):
    edges = hub_and_chain(3)
    g = Graph.from_edges(spark.createDataFrame(edges, "u long, v long, weight double"), attrs=("weight",)).pinned()
    sources = [0, 17, 72, 202, 203, 999]
    got = {}
    for r in weighted_distances(g, spark.createDataFrame([(s,) for s in [*sources, 0]], "node_id long"), delta=delta).collect():
        assert (r.src, r.node_id) not in got
        got[r.src, r.node_id] = r.d
    assert got == {(s, n): d for s in sources for n, d in searched(edges, s).items()}


def test_mean_over_reached_nodes_in_batches(spark):
    edges = hub_and_chain(4)
    g = Graph.from_edges(spark.createDataFrame(edges, "u long, v long, weight double"), attrs=("weight",)).pinned()
    want = {}
    for n in {x for u, v, _ in edges for x in (u, v)}:
        d = searched(edges, n)
        want[n] = -sum(d.values()) / (len(d) - 1) if len(d) > 1 else 0.0
    for batches in (None, 3):
        out = mean_weighted_distance(g, batches=batches)
        assert out.columns == ["node_id", "avg_w_shortest_path_length"]
        assert {r[0]: r[1] for r in out.collect()} == pytest.approx(want)
    named = compute_measures(g, ["w_shortest_path_length"])["w_shortest_path_length"]
    assert {r[0]: r[1] for r in named.collect()} == pytest.approx(want)


def test_no_edges_and_a_bad_width(spark):
    g = Graph.from_edges(spark.createDataFrame([], "u long, v long, weight double"), attrs=("weight",))
    assert mean_weighted_distance(g).count() == 0
    with pytest.raises(ValueError):
        weighted_distances(g, g.vertices, delta=0)
