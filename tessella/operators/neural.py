"""Forward passes of graph layers on arrays, losses, and classifier heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.runtime import cut


def neighbour_mean(graph: Graph, features: DataFrame) -> DataFrame:
    """(node_id, x, nb): own features and the mean over neighbours (zeros without any).

    Sums are divided once, so features that are whole numbers have exact means in any order of rows.
    Features are read three times and therefore written first.
    """
    return _neighbour_mean(graph, cut(features.select("node_id", "x"), "features"))


def _neighbour_mean(graph: Graph, x: DataFrame) -> DataFrame:
    one = x.select(F.size("x").alias("n")).first()
    width = one["n"] if one else 0
    near = graph.sym().select("a", "b").join(x.toDF("b", "xb"), "b")
    sums = near.groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("n"), *[F.sum(F.col("xb")[k]).alias(f"s{k}") for k in range(width)])
    cells = F.array(*[F.col(f"s{k}") / F.col("n") for k in range(width)]) if width else F.array().cast("array<double>")
    mean = sums.select("node_id", cells.alias("nb"))
    return x.join(mean, "node_id", "left").select("node_id", "x", F.coalesce("nb", F.transform("x", lambda v: F.lit(0.0))).alias("nb"))


def _dense(w_self: np.ndarray, w_near: np.ndarray, bias: np.ndarray, relu: bool):
    @F.pandas_udf("array<double>")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, nb in parts:
            if not len(x):
                yield pd.Series([], dtype=object)
                continue
            y = np.stack(x.to_list()) @ w_self + np.stack(nb.to_list()) @ w_near + bias
            yield pd.Series(list(np.maximum(y, 0.0) if relu else y))

    return apply


def sage_layer(graph: Graph, features: DataFrame, w_self: np.ndarray, w_near: np.ndarray, bias: np.ndarray, relu: bool = True) -> DataFrame:
    """(node_id, x): x W_self + mean of neighbours W_near + bias."""
    return _layer(graph, cut(features.select("node_id", "x"), "features"), w_self, w_near, bias, relu)


def _layer(graph: Graph, x: DataFrame, w_self: np.ndarray, w_near: np.ndarray, bias: np.ndarray, relu: bool = True) -> DataFrame:
    f = _dense(np.asarray(w_self), np.asarray(w_near), np.asarray(bias), relu)
    return _neighbour_mean(graph, x).select("node_id", f("x", "nb").alias("x"))


def skip_concat(graph: Graph, features: DataFrame, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Stacked layers, each reading the input and all earlier outputs side by side.

    What a layer reads is written once, so that no layer makes those before it again.
    """
    cur = features.select("node_id", "x")
    for w_self, w_near, bias in layers:
        cur = cut(cur, "layer")
        new = _layer(graph, cur, w_self, w_near, bias).withColumnRenamed("x", "y")
        cur = cur.join(new, "node_id").select("node_id", F.concat("x", "y").alias("x"))
    return cur


def mean_readout(features: DataFrame, key: str = "graph_id", width: int | None = None) -> DataFrame:
    """(key, vec): mean feature array per graph, combined before the shuffle.

    Every place of the array is a plain sum of its own. ``width`` is the length of
    the arrays; without it the features are written and a row is looked at.
    Arrays of another length and cells without a value are refused.
    """
    if width is None:
        features = cut(features.select(key, "x"), "features")
        one = features.select(F.size("x").alias("n")).first()
        width = one["n"] if one else 0
    sums = features.groupBy(key).agg(
        F.count("*").alias("n"), F.count(F.when((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()), 1)).alias("sound"),
        *[F.sum(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(width)])
    cells = F.array(*[F.col(f"s{k}") / F.col("n") for k in range(width)]).cast("array<double>")
    return sums.select(key, F.when(F.col("sound") == F.col("n"), cells).otherwise(F.raise_error(F.lit(f"features are not arrays of {width} numbers"))).alias("vec"))


def bilinear_score(df: DataFrame, w: np.ndarray, left: str = "x", right: str = "vec", out: str = "score") -> DataFrame:
    """left' W right, as array expressions."""
    w = np.asarray(w, dtype=float)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in w])

    def dot(a, b) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    proj = F.transform(rows, lambda r: dot(r, F.col(right)))
    return df.withColumn(out, dot(F.col(left), proj))


def mask_features(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Zero each feature with the given probability, seeded by row key and position; ``masked`` flags them."""
    hit = F.transform("x", lambda v, i: F.pmod(F.xxhash64("node_id", i, F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000))
    return df.withColumn("masked", hit).withColumn("x", F.zip_with("x", "masked", lambda v, m: F.when(m, 0.0).otherwise(v)))


def pairwise_distance(a: str, b: str, eps: float = 1e-6) -> Column:
    """Euclidean distance with a small constant added to every difference."""
    sq = F.zip_with(a, b, lambda p, q: F.pow(p - q + eps, F.lit(2)))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def contrastive_loss(pairs: DataFrame, a: str = "vec_a", b: str = "vec_b", label: str = "label", margin: float = 1.0) -> DataFrame:
    """One row: mean of y d^2 + (1 - y) max(0, margin - d)^2."""
    d = pairwise_distance(a, b)
    y = F.col(label)
    return pairs.agg(F.avg(y * d * d + (1 - y) * F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), F.lit(2))).alias("contrastive_loss"))


def masked_error(df: DataFrame, pred: str = "pred", truth: str = "x", masked: str = "masked") -> DataFrame:
    """One row: mean squared error over masked positions only, 0 if there are none."""
    z = F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t"), F.col(masked).alias("m"))).alias("z")
    err = df.select(z).where("z.m").agg(F.avg(F.pow(F.col("z.p") - F.col("z.t"), F.lit(2))).alias("e"))
    return err.select(F.coalesce("e", F.lit(0.0)).alias("masked_error"))


def total_loss(contrastive: float, prediction: float, alpha: float = 1.0, beta: float = 1.0) -> float:
    return alpha * contrastive + beta * prediction


def train_head(df: DataFrame, kind: str = "logistic", hidden: tuple[int, ...] = (64, 32), classes: int = 2, label: str = "y", seed: int = 42, max_iter: int = 100):
    """A fitted classifier on arrays ``x``: 'logistic' or 'mlp'."""
    data = df.select(array_to_vector("x").alias("features"), F.col(label).cast("double").alias("label"))
    if kind == "logistic":
        model = LogisticRegression(maxIter=max_iter)
    elif kind == "mlp":
        width = len(df.select("x").first()["x"])
        model = MultilayerPerceptronClassifier(layers=[width, *hidden, classes], seed=seed, maxIter=max_iter)
    else:
        raise ValueError(f"unknown head {kind!r}")
    return Pipeline(stages=[model]).fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    scored = model.transform(df.withColumn("features", array_to_vector("x")))
    return scored.withColumn("prob", vector_to_array("probability")).drop("features", "rawPrediction", "probability")
