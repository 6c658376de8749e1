"""Encodings, statistics, sources and the traps of the node tables."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import residues
from tessella.operators import dataset as DS
from tessella.operators import encode as EN
from tessella.operators import enrichment as G
from tessella.operators import labels as L
from tessella.operators import nodes as N
from tessella.runtime import exact_quantiles, global_rank
from tessella.sources import schemas as SC
from tessella.sources import tables as ST


def test_bins_match_cut_and_qcut(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=400).round(3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(400), "x": x}))
    got = EN.quantile_bins(EN.equal_width_bins(df, "x", "b", 42), "x", "q", 10).orderBy("i").toPandas()
    assert (got.b == pd.cut(x, 42, labels=False, include_lowest=True)).all()
    assert (got.q == pd.qcut(x, 10, labels=False, duplicates="drop")).all()
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert {r.b for r in EN.equal_width_bins(flat, "x", "b", 42).collect()} == set(pd.cut([1.0, 1.0], 42, labels=False))


def test_global_rank_and_quantiles(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(300)], "k long, x double").repartition(5)
    got = global_rank(df, F.col("x"), F.col("k")).orderBy("rn").toPandas()
    assert list(got.rn) == list(range(1, 301)) and got.x.is_monotonic_increasing
    probs = [0.0, 0.1, 0.33, 0.5, 1.0]
    want = np.quantile([float((i * 37) % 101) for i in range(300)], probs)
    assert exact_quantiles(df, "x", probs) == pytest.approx(list(want))


def test_permutation_paths_and_expectation(spark):
    rng = np.random.default_rng(0)
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": range(60), "residue_name": ["a", "b", "c"] * 20, "v": rng.integers(0, 4, 60).astype(float)}))
    clusters = spark.createDataFrame([(0, i) for i in range(9)] + [(1, i) for i in range(20, 26)], "cluster_id long, node_id long")
    st = G.with_strata(nodes, "v", "res")
    a = {r.cluster_id: r for r in G.permutation_test(clusters, st, 4000, min_sum=0, chunk=1000).collect()}
    b = {r.cluster_id: r for r in G.permutation_test(clusters, st, 300, min_sum=0, chunk=100, pool_entries=0).collect()}
    exact = {r.cluster_id: r for r in G.expected_null(clusters, st).collect()}
    for c in (0, 1):
        se = exact[c].null_variance ** 0.5
        assert abs(a[c].expected_sum - exact[c].expected_sum) < 5 * se / 4000**0.5
        assert abs(b[c].expected_sum - exact[c].expected_sum) < 5 * se / 300**0.5
        assert 1 / 4001 <= a[c].p_value <= 1 and abs(a[c].p_value - b[c].p_value) < 0.2
    again = {r.cluster_id: r.p_value for r in G.permutation_test(clusters.repartition(3), st, 4000, min_sum=0, chunk=1000).collect()}
    assert again == {c: a[c].p_value for c in a}


def test_missing_scores_do_not_win(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "a", float("nan")), (3, "a", 0.5)], "node_id long, residue_name string, v double")
    assert [r.node_id for r in G.with_strata(nodes, "v", "res").collect()] == [3]


def test_q_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5, 0.03])], "i long, p_value double")
    got = [r.q_value for r in G.q_values(df).orderBy("i").collect()]
    assert got == pytest.approx([0.0375, 0.0375, 0.0375, 0.5, 0.0375])


def test_equal_width_bins_take_the_edges(spark):
    """Ranges whose quotient misses the last bin by a rounding step."""
    rng = np.random.default_rng(3)
    rows, k = [], 0
    while len(rows) < 120:
        lo, hi = rng.uniform(-5, 5), rng.uniform(5, 90)
        k += 1
        if np.ceil((hi - lo) / ((hi - lo) / 42)) > 42 or k % 400 == 0:
            rows += [(k, lo), (k, hi), (k, (lo + hi) / 2)]
    for key in {r[0] for r in rows}:
        x = [v for g, v in rows if g == key]
        got = EN.equal_width_bins(spark.createDataFrame([(v,) for v in x], "x double"), "x", "b", 42).collect()
        assert {r.x: r.b for r in got} == dict(zip(x, pd.cut(x, 42, labels=False)))


def test_null_keys_stay_out_of_labels(spark):
    df = spark.createDataFrame([("ENST1", 0.9, "c.12A>T"), ("ENST1", 0.2, "c.12A>G"), ("ENST2", 0.9, "none"), ("X", 0.9, "c.1A>T")],
                               "`Accession Number` string, `FATHMM score` double, `Mutation CDS` string")
    assert [tuple(r) for r in L.cosmic_status(df, 80).collect()] == [("ENST1", 12, "ala", 1)]


def test_mutability_counts_null_contexts(spark):
    ctx = spark.createDataFrame([("n", ["ACGTA", None], ["ACGTA"]), ("m", None, None)], "node_id string, cds_contexts array<string>, unique_cds_contexts array<string>")
    model = spark.createDataFrame([("ACG", "ATG", 0.4), ("CGT", "CAT", 0.2)], "ctx string, mut string, freq double")
    got = {r.node_id: r.mutability for r in N.mutability(ctx, model).collect()}
    # CGT (R) -> TGT (C) by ACG>ATG and -> CAT (H) by CGT>CAT; half of the transcripts carry the context.
    assert got == {"n": pytest.approx(0.3), "m": None}


def test_lists_with_none(spark):
    df = spark.createDataFrame([("['a', None]",), ("[]",), (None,), ("oops",)], "x string")
    assert [r[0] for r in df.select(residues.parse_list(F.col("x"))).collect()] == [["a", None], [], [], []]


def test_copy_fold_differs_from_maximum(spark):
    df = spark.createDataFrame([("p1-1_3_ala", "p1"), ("p1-2_3_ala", "p1"), ("p2_3_ala", "p2")], "node_id string, uniprot_id string")
    assert {r.uniprot_id: r.copy_num for r in N.copy_numbers(df).collect()} == {"p1": 3, "p2": 1}
    assert {r.uniprot_id: r.copy_num for r in N.copy_numbers(df, parity=True).collect()} == {"p1": 2, "p2": 1}


def test_plain_numbers_need_a_switch(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 30.0)], "node_id string, mutability double, dssp_phi double")
    assert EN.encode_features(df, ["mutability", "dssp_phi"]).numeric == ["phi_is_na", "dssp_phi_sin", "dssp_phi_cos"]
    assert EN.encode_features(df, ["mutability"], passthrough_numeric=True).numeric == ["mutability"]


def test_workbook(spark, tmp_path):
    rows = [["x"], ["y"], ["Transcript ID", "gwCHASMplus score", "mutation", "Novel"], ["ENST1", "0.5", "p.A12V", "n"]]
    body = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    path = tmp_path / "b.xlsx"
    path.write_bytes(buf.getvalue())
    df = ST.read_workbook(spark, str(path), SC.CHASMPLUS, skip=2)
    assert [tuple(r) for r in L.chasmplus_status(df).collect()] == [("ENST1", 12, "ala", 1)]


def test_split_is_disjoint_and_seeded(spark):
    comps = spark.createDataFrame([(i, i % 25) for i in range(400)], "node_id long, component_id long")
    a = {r.component_id: r.split for r in DS.split_components(comps).collect()}
    assert a == {r.component_id: r.split for r in DS.split_components(comps.repartition(7)).collect()}
    # 22 components are drawn: ceil(4.4) to test, then ceil(17 / 8) to validation.
    assert len(a) == 25 and list(a.values()).count("test") == 5 and list(a.values()).count("val") == 3


def test_equal_balls_are_kept_once(spark, make):
    from tessella.graph import Graph

    ring = [(i, (i + 1) % 120) for i in range(120)]
    g = make(ring + [(0, 200)])
    v = g.vertices.withColumn("is_mut", F.col("node_id").isin(10, 50, 0).cast("int"))
    g = Graph(v, g.edges)
    balls = DS.anchored_balls(g, ratio=1.0)
    assert {r.anchor for r in balls.collect()} == {0, 10, 50}
    assert {r.anchor for r in DS.distinct_balls(g, balls).collect()} == {0, 10}


def test_shape_check_tells_equal_degrees_apart():
    from tessella.operators.dataset import _same_shape

    def near(pairs):
        out = {}
        for a, b in pairs:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
        return out

    prism = near([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)])
    k33 = near([(a, b) for a in range(3) for b in range(3, 6)])
    moved = near([(10 - a, 10 - b) for a, bs in prism.items() for b in bs])
    flat = {n: 0 for n in range(6)}
    assert not _same_shape(prism, flat, k33, flat)
    assert _same_shape(prism, flat, moved, {n: 0 for n in moved})
