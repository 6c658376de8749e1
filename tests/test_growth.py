"""Steps whose work must stay in proportion to their rows, told by their plans and by what is read twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import neural as NN


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_readout_is_summed_by_hash(spark):
    """Per-graph sums are plain ones: objects per graph fall back to sorting all rows."""
    rows = [(i, i % 300, [float(i), i / 4]) for i in range(900)]
    x = spark.createDataFrame(rows, "node_id long, graph_id long, x array<double>")
    out = NN.mean_readout(x, width=2)
    assert "SortAggregate" not in plan(out) and "ObjectHashAggregate" not in plan(out)
    want = {g: [np.mean([r[2][k] for r in rows if r[1] == g]) for k in (0, 1)] for g in range(300)}
    for got in (out, NN.mean_readout(x)):
        assert {r.graph_id: pytest.approx(r.vec) for r in got.collect()} == want
    with pytest.raises(Exception, match="arrays of 2 numbers"):
        NN.mean_readout(spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0])], x.schema), width=2).collect()
    assert NN.mean_readout(x.limit(0)).collect() == []


def test_layers_make_their_features_once(spark, make):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def told(n):
        seen.add(1)
        return [float(n), 1.0]

    g = make([(i, i + 1) for i in range(19)])
    x = g.vertices.select("node_id", told("node_id").alias("x"))
    w1, w2, b = np.ones((2, 2)), np.ones((4, 2)), np.zeros(2)
    assert NN.skip_concat(g, x, [(w1, w1, b), (w2, w2, b)]).count() == 20
    assert seen.value == 20


def test_one_attribute_of_edges_is_chosen_by_hash(spark, monkeypatch):
    import tessella.graph as G

    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, label: plans.append(plan(df)) or cut(df, label))
    rows = [("b", "a", 1.0), ("a", "b", 3.0), ("a", "b", None), ("c", "a", None), (None, "a", 4.0), ("d", "c", float("nan")), ("c", "d", 2.0)]
    g = Graph.from_edges(spark.createDataFrame(rows, "u string, v string, weight double"), attrs=("weight",))
    assert "SortAggregate" not in plans[0]
    assert sorted((r.u, r.v, str(r.weight)) for r in g.edges.collect()) == [("a", "b", "3.0"), ("a", "c", "None"), ("c", "d", "nan")]


def test_distinct_balls_keep_no_row_for_each_node_of_a_ball(spark, make, monkeypatch):
    """Balls are drawn as arrays; no table written has a row for each node or edge of each ball."""
    import random

    from tessella.operators import dataset as DS

    rng = random.Random(3)
    pairs = {(i, (i + 1) % 200) for i in range(200)} | {tuple(rng.sample(range(200), 2)) for _ in range(25)}
    g = make(sorted(pairs))
    flagged = {i for i in range(200) if rng.random() < 0.5}
    g = Graph(g.vertices.withColumn("is_mut", F.col("node_id").isin(*flagged).cast("int")), g.edges)
    balls = DS.anchored_balls(g, ratio=1.0, steps=2, max_size=40)
    rows = balls.collect()
    written, cut = [], DS.cut

    def told(df, label):
        out = cut(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(DS, "cut", told)
    got = {(r.component_id, r.anchor) for r in DS.distinct_balls(g, balls).collect()}
    assert max(written) <= 200 < len(rows)

    members: dict = {}
    for r in rows:
        members.setdefault(r.anchor, set()).add(r.node_id)
    shapes, want = [], set()
    for a in sorted(members):
        near = {n: set() for n in members[a]}
        for u, v in pairs:
            if u in near and v in near:
                near[u].add(v)
                near[v].add(u)
        shape = near, {n: int(n in flagged) for n in near}
        if not any(DS._same_shape(*shape, *s) for s in shapes):
            shapes.append(shape)
            want.add((0, a))
    assert got == want and len(want) < len(members)


def test_like_components_do_not_slow_the_spectral_radius(make, monkeypatch):
    """Components of nearly equal radius settle each for itself, after a few steps."""
    from tessella.operators import spectral as SP

    rng = np.random.default_rng(4)
    pairs, weights, want = [], [], 0.0
    for c in range(30):
        a = np.zeros((12, 12))
        for i in range(12):
            for j in range(i):
                if rng.random() < 0.7:
                    a[i, j] = a[j, i] = rng.integers(1, 4)
                    pairs.append((100 * c + j, 100 * c + i))
                    weights.append(-a[i, j])
        want = max(want, np.linalg.eigvalsh(a)[-1])
    g = make(pairs + [(9_000, 9_001)], nodes=(9_999,), weights=weights + [2.0])
    labels, cut = [], SP.cut
    monkeypatch.setattr(SP, "cut", lambda df, label: labels.append(label) or cut(df, label))
    assert SP.spectral_radius(g, max_steps=12) == pytest.approx(want, rel=1e-8)
    assert labels.count("krylov") <= 25


@pytest.mark.parametrize("values, total", [(1, 1), (1, 9), (3, 40), (300, 2_000), (300, 900_000), (3_000, 3_000_000), (200_000, 1_000_000)])
def test_drawn_places_are_looked_up_not_searched(monkeypatch, values, total):
    """A draw is a step into a table of its stratum; a search for every place took most of a permutation test."""
    from tessella.operators import enrichment as G

    rng = np.random.default_rng(values)
    counts = 1 + (rng.multinomial(total - values, np.ones(values) / values) if values < 3_000 else np.bincount(rng.zipf(1.5, total - values) % values, minlength=values))
    held, ends = np.sort(rng.random(values)), np.cumsum(counts)
    pool = G.Pool(held, counts)
    places = np.unique(np.clip(np.concatenate([rng.integers(0, total, 5_000), ends, ends - 1, [0, total - 1]]), 0, total - 1))
    assert np.array_equal(pool.at(places), held[np.searchsorted(ends, places, side="right")])
    searched, search = [0], np.searchsorted

    def told(a, v, **kw):
        searched[0] += np.size(v)
        return search(a, v, **kw)

    monkeypatch.setattr(np, "searchsorted", told)
    for k in (1, 3):
        if k < total:
            G._sum_of_draws(np.random.default_rng(0), held, counts, k, 2_000, pool)
    assert searched[0] <= 2_000


def test_rows_with_a_number_twice():
    from tessella.operators import enrichment as G

    rng = np.random.default_rng(3)
    for k in (2, 3, 8, 9, 20):
        picks = rng.integers(0, 4 * k, size=(500, k))
        assert list(G._repeated(picks)) == [i for i, row in enumerate(picks) if len(set(row)) < k]


def test_contacts_spell_a_node_once_a_line(spark, tmp_path):
    """The rows of the text, nulls and repeated lines included, but no name is put together beside or after the join."""
    from tessella.plans.fixtures import CONTACTS, contact_rows, derive

    rows = [(o, p, p % 7, n, 1.0, f / 100, t / 100, "R") for o in (16, 18, 17, 101, 202) for n, (p, f, t) in enumerate([(10, 3, 1), (21, 0, 8), (21, 5, 5), (-30, 9, 2), (-41, 10, 0), (45, 3, 1), (10, 1, 4)])]
    rows += [rows[0], rows[1], (None, 5, 1, 1, 1.0, 0.1, 0.1, "R"), (5, None, 1, 1, 1.0, 0.1, 0.1, "R"), (5, 6, 1, 2, 1.0, None, 0.1, "R"), (5, 7, 1, 3, 1.0, 0.1, None, "R"), (5, 8, 1, None, 1.0, 0.1, 0.1, "R"), (5, 9, 1, 4, 1.0, 0.1, 0.1, None)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = contact_rows(spark, str(tmp_path))
    told = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert told(got) == told(derive(spark, str(tmp_path), CONTACTS)) and got.count() == 5
    # from the top to the join; filters on the ends used to be pushed down with both names spelled out in them
    upper = plan(got.where("u is not null and v is not null")).split("Join")[0]
    assert "lower(" not in upper and "lpad(" not in upper


def test_endpoints_read_their_table_once(spark):
    from tessella.operators import edges as E

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(n):
        seen.add(1)
        return None if n == 3 else f"n{n}"

    df = spark.range(8, numPartitions=2).select(told("id").alias("nodeid_1"), F.lit("x").alias("nodeid_2"))
    assert {r.node_id for r in E.unique_endpoints(df).collect()} == {"x", None, *(f"n{n}" for n in range(8) if n != 3)}
    narrow = spark.range(8).select(F.col("id").alias("nodeid_1"), (F.col("id") + 1).alias("nodeid_2"))
    assert plan(E.unique_endpoints(narrow)).count("Range (") == 1 and E.unique_endpoints(narrow).count() == 9
    assert seen.value == 8


def test_plain_gml_records_are_cut_at_their_bracket(spark, tmp_path, monkeypatch):
    """Only records with quotes or brackets in them go through the patterns that pass over these."""
    import tessella.graph as G
    from tessella.sources.graphs import read_gml

    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, label: plans.append(plan(df)) or cut(df, label))
    lines = [
        'graph [ node [ id 1 label "x" ]', "node [id 2] edge[source 1 target 2]", " edge [ source 2 target -3 weight 2.5 ]", "edge [ source 4 target 5 graphics [ a [ b 1 ] ] value 3 ]",
        'edge [ source 6 target 7 label "edge [ source 9 ]" ]', "edge source 8", "edge [ source 10", "target 11", " weight 1e3", "]", 'edge [ source 12 label "]" target 13 ]', "edge [ source 14 ] target 15",
        "edge\n[ source 16 target 17 ]x", "edge [", "edge [ source 20 ]] target 21", 'edge [ "a" source 22 target 23 ] [', "node [ id 30 ]", "edge [ source 31 target 32", "]"]
    (tmp_path / "g.gml").write_text("\n".join(lines))
    g = read_gml(spark, f"file://{tmp_path}/g.gml")
    assert "substring_index" in plans[0]
    assert sorted((r.u, r.v, r.weight) for r in g.edges.collect()) == [
        (-3, 2, 2.5), (1, 2, 1.0), (4, 5, 3.0), (6, 7, 1.0), (10, 11, 1000.0), (12, 13, 1.0), (16, 17, 1.0), (22, 23, 1.0), (31, 32, 1.0)]
    assert {1, 2, 30} <= {r.node_id for r in g.vertices.collect()}
