"""The exact null law against enumeration, against drawing, and on its edges."""

import itertools
import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest


def tail_by_enumeration(pools, strata, obs):
    """P(sum >= obs) over all ways to draw strata[s] items from every pool."""
    law = Counter({0: 1.0})
    for s, k in strata.items():
        own = Counter(sum(x) for x in itertools.combinations(pools[s], k))
        n = sum(own.values())
        law = added(law, {v: c / n for v, c in own.items()})
    return sum(p for v, p in law.items() if v >= obs), sum(v * p for v, p in law.items())


def added(a, b):
    out = Counter()
    for (x, p), (y, q) in itertools.product(a.items(), b.items()):
        out[x + y] += p * q
    return out


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    from tessella.functions.laws import hypergeometric, log_factorial

    rows = [(t, n, c, k) for n, c, k in ((5, 2, 3), (21, 21, 4), (60, 25, 40), (10_000, 37, 500), (3_000_000, 900_000, 13)) for t in range(max(0, k - n + c), min(k, c) + 1)]
    df = spark.createDataFrame(rows, "t long, n long, c long, k long")
    for r in df.withColumn("p", hypergeometric(F.col("t"), F.col("n"), F.col("c"), F.col("k"))).collect():
        want = float(Fraction(math.comb(r.c, r.t) * math.comb(r.n - r.c, r.k - r.t), math.comb(r.n, r.k)))
        assert r.p == pytest.approx(want, rel=1e-10)
    for n, x in spark.range(0, 200).select("id", log_factorial(F.col("id"))).collect():
        assert x == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-13)


def test_exact_test(spark):
    from tessella.operators.exact_test import exact_test
    from tessella.operators.enrichment import permutation_test

    pools = {"a": [0, 0, 0, 0, 1, 1, 2, 7], "b": [0, 0, 3, 3, 3], "c": [5, 5], "d": [-2, 0, 1]}
    nodes = [(f"{s}{i}", s, float(v)) for s, vs in pools.items() for i, v in enumerate(vs)]
    groups = {1: ["a7", "a6", "b2"], 2: ["a0", "a1", "b0"], 3: ["c0", "c1"], 4: ["a4", "b2", "b3", "c0", "d2"], 5: ["a5", "b1", "b4", "c1", "d0"], 6: ["a3", "unknown"], 7: ["unknown"]}
    strata = spark.createDataFrame(nodes, "node_id string, stratum string, value double")
    clusters = spark.createDataFrame([(c, n) for c, ns in groups.items() for n in ns], "cluster_id long, node_id string")
    got = {r.cluster_id: r for r in exact_test(clusters, strata, min_sum=None).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}  # no node of 7 has a stratum
    value = {n: v for n, _, v in nodes}
    for c, ns in groups.items():
        ns = [n for n in ns if n in value]
        if not ns:
            continue
        taken = defaultdict(int)
        for n in ns:
            taken[n[0]] += 1
        p, mean = tail_by_enumeration(pools, taken, sum(value[n] for n in ns))
        assert got[c].p_value == pytest.approx(p, rel=1e-12) and got[c].expected_sum == pytest.approx(mean, rel=1e-12)
        assert got[c].cluster_size == len(ns) and got[c].observed_sum == sum(value[n] for n in ns)
    n = 20_000
    for r in permutation_test(clusters, strata, n, min_sum=None).collect():
        p = got[r.cluster_id].p_value
        assert abs(r.null_ge_obs / n - p) <= 6 * math.sqrt(max(p * (1 - p), 1 / n) / n)
    mean = {r.cluster_id: r for r in exact_test(clusters, strata, "mean", min_sum=6, min_nodes=3).collect()}
    assert set(mean) == {1, 4, 5} and mean[1].observed_mean == 4 and mean[1].p_value == pytest.approx(got[1].p_value)


def test_exact_test_edges(spark):
    from tessella.operators.exact_test import exact_test

    strata = spark.createDataFrame([("x", "s", 1.0), ("y", "s", 0.0)], "node_id string, stratum string, value double")
    none = spark.createDataFrame([], "cluster_id long, node_id string")
    assert exact_test(none, strata).count() == 0
    assert exact_test(spark.createDataFrame([(1, "x")], none.schema), strata.limit(0), min_sum=None).count() == 0
    with pytest.raises(ValueError):
        exact_test(none, spark.createDataFrame([("x", "s", 0.5)], strata.schema))
    with pytest.raises(ValueError):
        exact_test(none, strata, "median")
    # a hub of equal items: 3,000 draws of 9,000 keep their digits far out in the tail
    many = spark.range(9000).selectExpr("cast(id as string) node_id", "'s' stratum", "cast(case when id < 30 then 1 else 0 end as double) value")
    big = spark.range(3000).selectExpr("1L cluster_id", "cast(id as string) node_id")
    (r,) = exact_test(big, many).collect()
    want = math.prod((3000 - i) / (9000 - i) for i in range(30))
    assert r.observed_sum == 30 and r.p_value == pytest.approx(want, rel=1e-8) and r.p_value < 1e-14


@pytest.mark.parametrize("bounds", [{"law_span": 12}, {"pool_entries": 0}, {}])
def test_laws_on_arrays_and_by_joins(spark, monkeypatch, bounds):
    from tessella.operators import exact_test as ET

    pools = {"a": [0, 0, 0, 1, 1, 2, 7], "b": [0, 0, 3, 3, 3], "c": [-2, 0, 1]}
    nodes = [(f"{s}{i}", s, float(v)) for s, vs in pools.items() for i, v in enumerate(vs)]
    value = {n: v for n, _, v in nodes}
    groups = {1: ["a6", "b2"], 2: ["a0", "a6", "b3", "b4", "c0"], 3: ["c0", "c1"], 4: ["a1", "a2", "a3", "c2"]}
    summed = []
    monkeypatch.setattr(ET, "sum_laws", lambda parts, laws, f=ET.sum_laws: summed.append({r.law for r in parts.collect()}) or f(parts, laws))
    clusters = spark.createDataFrame([(c, n) for c, ns in groups.items() for n in ns], "cluster_id long, node_id string")
    got = {r.cluster_id: r for r in ET.exact_test(clusters, spark.createDataFrame(nodes, "node_id string, stratum string, value double"), min_sum=None, **bounds).collect()}
    assert set(got) == set(groups)
    for c, ns in groups.items():
        p, mean = tail_by_enumeration(pools, Counter(n[0] for n in ns), sum(value[n] for n in ns))
        assert got[c].p_value == pytest.approx(p, rel=1e-12) and got[c].expected_sum == pytest.approx(mean, rel=1e-12)
    # only what does not fit into an array is added by joins
    assert [len(x) for x in summed] == ([] if not bounds else [4] if "pool_entries" in bounds else [2])


def test_few_draws_take_no_step_for_every_value():
    import numpy as np

    from tessella.operators.enrichment import _sum_of_draws

    class Counted(np.random.Generator):
        def multivariate_hypergeometric(self, *args, **kw):
            raise AssertionError("a step for every value")

    values, counts = np.array([0.0, 1.0, 2.0, 9.0]), np.array([50, 30, 15, 5])
    pool = np.repeat(values, counts)
    for k in (1, 2, 4):
        got = _sum_of_draws(Counted(np.random.PCG64(3)), values, counts, k, 200_000)
        spread = math.sqrt(k * pool.var(ddof=1) * (1 - k / 100))
        assert got.shape == (200_000,) and abs(got.mean() - k * pool.mean()) < 5 * spread / math.sqrt(200_000) and abs(got.std() / spread - 1) < 0.02
    pair = _sum_of_draws(Counted(np.random.PCG64(4)), np.array([1.0, 9.0]), np.array([5, 1]), 2, 50_000)
    assert set(pair) == {2.0, 10.0} and abs((pair == 10).mean() - 1 / 3) < 0.02  # never the same item twice
