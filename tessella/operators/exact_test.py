"""The exact null law of a cluster's sum under stratified draws without replacement.

What a permutation test estimates by drawing is here a table. The sum of k draws
from one stratum follows from how often each integer value occurs in it: the
draws are dealt to the values one after the other, each time by a hypergeometric
law, and a row (stratum, k, draws left, sum so far) carries a probability. All
strata and draw counts go through the same round side by side, so the number of
rounds is the number of distinct values of the richest stratum. The laws of a
cluster's strata are then added: as arrays where the laws of all strata fit into
a task and the sums of a cluster span little, else pairwise by joins, half of
the strata in each round. Clusters with the same draws from the same strata
share one law.

All terms are positive, so small p-values keep their digits: there is no least
p-value of 1 / (permutations + 1). Rows grow with draws times sums of a stratum;
only the joins also have rows that grow with the square of a cluster's sums.
Nothing is drawn and no seed is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.laws import hypergeometric
from tessella.operators.enrichment import POOL_ENTRIES, enrichment_ratio
from tessella.runtime import cut, no_rows

# Span of a cluster's sums up to which its law is one array.
LAW_SPAN = 16_384


def stratum_laws(pools: DataFrame, draws: DataFrame) -> DataFrame:
    """(stratum, k, s, p): law of the sum of ``k`` draws, for every row of ``draws(stratum, k)``.

    ``pools(stratum, value, c)`` says how often each long value occurs. A stratum
    without a pool or with fewer than k items has no law.
    """
    # the commonest value last: what is left then falls to it, without a choice
    by_count = Window.partitionBy("stratum").orderBy("c", "value")
    rest = by_count.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = cut(pools.withColumn("i", F.row_number().over(by_count)).withColumn("total", F.sum("c").over(rest)), "steps")
    sizes = steps.where("i = 1").select("stratum", F.col("total").alias("n"))
    state = draws.select("stratum", F.col("k").cast("long").alias("k")).distinct().join(sizes, "stratum").where("k <= n").select(
        "stratum", "k", F.col("k").alias("left"), F.lit(0).cast("long").alias("s"), F.lit(1.0).alias("p"))
    for i in range(1, (steps.agg(F.max("i")).first()[0] or 0) + 1):
        step = steps.where(F.col("i") == i).drop("i")
        dealt = state.join(step, "stratum", "left").withColumn("c", F.when(F.col("left") > 0, F.col("c")))
        least = F.greatest(F.lit(0).cast("long"), F.col("left") - (F.col("total") - F.col("c")))
        options = F.coalesce(F.sequence(least, F.least("left", "c")), F.array(F.lit(0).cast("long")))
        dealt = dealt.withColumn("t", F.explode(options))
        share = F.when(F.col("c").isNull(), F.lit(1.0)).otherwise(hypergeometric(F.col("t"), F.col("total"), F.col("c"), F.col("left")))
        dealt = dealt.select("stratum", "k", (F.col("left") - F.col("t")).alias("left"), (F.col("s") + F.col("t") * F.coalesce("value", F.lit(0))).alias("s"), (F.col("p") * share).alias("p"))
        state = cut(dealt.groupBy("stratum", "k", "left", "s").agg(F.sum("p").alias("p")), "dealt")
    return state.select("stratum", "k", "s", "p")


def sum_laws(parts: DataFrame, laws: DataFrame) -> DataFrame:
    """(law, s, p): law of the sum over the strata of every ``law`` in ``parts(law, i, stratum, k)``, i = 0, 1, ..."""
    rounds = math.ceil(math.log2((parts.agg(F.max("i")).first()[0] or 0) + 1))
    state = parts.join(laws, ["stratum", "k"]).select("law", F.col("i").cast("long").alias("i"), "s", "p")
    for _ in range(rounds):
        half = F.expr("i div 2")
        even = state.where("i % 2 = 0").select("law", half.alias("i"), "s", "p")
        odd = state.where("i % 2 = 1").select(F.col("law").alias("l2"), half.alias("i2"), F.col("s").alias("s2"), F.col("p").alias("p2"))
        both = even.join(odd, (F.col("law") == F.col("l2")) & (F.col("i") == F.col("i2")), "left")
        added = both.select("law", "i", (F.col("s") + F.coalesce("s2", F.lit(0))).alias("s"), (F.col("p") * F.coalesce("p2", F.lit(1.0))).alias("p"))
        state = cut(added.groupBy("law", "i", "s").agg(F.sum("p").alias("p")), "added")
    return state.select("law", "s", "p")


def _tails_on_arrays(asked: DataFrame, laws: DataFrame, span: int) -> DataFrame:
    """(law, obs, mean, p_value) of ``asked(law, obs, strata)``; nulls where a sum spans more or a stratum has no law.

    All of ``laws`` goes to every task.
    """
    spark = asked.sparkSession
    table = {}
    for (stratum, k), rows in laws.toPandas().groupby(["stratum", "k"], sort=False):
        low, width = int(rows["s"].min()), int(rows["s"].max() - rows["s"].min()) + 1
        if width <= span:
            dense = np.zeros(width)
            dense[rows["s"].to_numpy() - low] = rows["p"]
        table[stratum, int(k)] = (low, dense) if width <= span else None
    shared = spark.sparkContext.broadcast(table)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, low, law, over, mean = shared.value, None, 0, None, None, 0.0
        for pdf in batches:
            out = []
            for name, obs, parts in zip(pdf["law"], pdf["obs"], pdf["strata"]):
                if name != last:
                    last, law = name, None
                    own = [known.get((x["stratum"], int(x["k"]))) for x in parts]
                    if all(own) and sum(len(p) for _, p in own) <= span:
                        low, law = own[0]
                        for more, p in own[1:]:
                            low, law = low + more, np.convolve(law, p)
                        over = law[::-1].cumsum()[::-1]
                        mean = float((low + np.arange(len(law))) @ law)
                if law is None:
                    out.append((name, obs, None, None))
                elif obs < low + len(law):
                    out.append((name, obs, mean, min(1.0, float(over[max(obs - low, 0)]))))
            yield pd.DataFrame(out, columns=["law", "obs", "mean", "p_value"])

    together = asked.repartition("law").sortWithinPartitions("law")
    return together.mapInPandas(tails, "law string, obs long, mean double, p_value double")


def exact_test(clusters: DataFrame, strata: DataFrame, statistic: str = "sum", min_sum: float | None = 5, min_nodes: int = 1,
               pool_entries: int = POOL_ENTRIES, law_span: int = LAW_SPAN) -> DataFrame:
    """Exact upper tail of every cluster's sum (or mean), with the columns of the permutation test.

    ``clusters(cluster_id, node_id)``, ``strata(node_id, stratum, value)`` with
    whole numbers as values; others raise. Nodes of a cluster without a stratum
    do not count, clusters of fewer than ``min_nodes`` counted nodes or with a
    sum below ``min_sum`` are not tested. A cluster that holds a whole stratum
    has p-value 1 as far as that stratum goes; empty tables give no rows.
    """
    if statistic not in ("sum", "mean"):
        raise ValueError("statistic must be 'sum' or 'mean'")
    if not no_rows(strata.where(F.col("value") != F.floor("value"))):
        raise ValueError("exact_test needs whole numbers; use permutation_test for others")
    members = clusters.join(strata, "node_id").groupBy("cluster_id", "stratum").agg(F.count("*").alias("k"), F.sum(F.col("value").cast("long")).alias("s"))
    per = members.groupBy("cluster_id").agg(F.sum("k").alias("size"), F.sum("s").alias("obs"), F.array_sort(F.collect_list(F.struct("stratum", "k"))).alias("strata"))
    per = per.where(F.col("size") >= min_nodes)
    if min_sum is not None:
        per = per.where(F.col("obs") >= min_sum)
    per = cut(per.withColumn("law", F.sha2(F.to_json("strata"), 256)), "tested")
    parts = cut(per.dropDuplicates(["law"]).select("law", F.posexplode("strata").alias("i", "part")).select("law", "i", "part.stratum", "part.k"), "parts")
    pools = strata.groupBy("stratum", F.col("value").cast("long").alias("value")).agg(F.count("*").alias("c"))
    laws = cut(stratum_laws(pools, parts), "laws")
    done = None
    if laws.count() <= pool_entries:
        told = cut(_tails_on_arrays(per.select("law", "obs", "strata").dropDuplicates(["law", "obs"]), laws, law_span), "tails")
        done, far = told.where("p_value is not null"), cut(told.where("p_value is null").select("law").distinct(), "far")
        parts = parts.join(far, "law", "left_semi")
    if done is None or not no_rows(far):
        asked = per.select("law", "obs").distinct()
        sums = cut(sum_laws(cut(parts, "parts"), laws), "sums")
        means = sums.groupBy("law").agg(F.sum(F.col("s") * F.col("p")).alias("mean"))
        tails = asked.join(sums, "law").where("s >= obs").groupBy("law", "obs").agg(F.least(F.lit(1.0), F.sum("p")).alias("p_value"))
        rest = means.join(tails, "law").select("law", "obs", "mean", "p_value")
        done = rest if done is None else done.unionAll(rest)
    scale = F.col("size") if statistic == "mean" else F.lit(1)
    obs, exp = F.col("obs") / scale, F.col("mean") / scale
    return per.join(done, ["law", "obs"]).select(
        "cluster_id", F.col("size").alias("cluster_size"), obs.alias(f"observed_{statistic}"), exp.alias(f"expected_{statistic}"),
        enrichment_ratio(obs, exp).alias("enrichment_score"), "p_value")
