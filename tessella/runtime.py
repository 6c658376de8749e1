"""Session settings and the shared-folder cut used by every iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "tessella", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the job, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("tessella", os.path.relpath(full, root)))
    sc.addPyFile(path)  # the driver serves the file to the executors
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="tessella-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str = "cut") -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This ends the lineage (a lost executor re-reads files instead of replaying
    the loop) and gives Catalyst the true size of the table for the next plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_rows(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the single row of ``stats`` as columns, through a scalar subquery."""
    one = stats.select(F.struct(*stats.columns).alias("_s"))
    out = df.withColumn("_s", one.scalar())
    return out.select(*df.columns, *[F.col("_s").getField(c).alias(c) for c in stats.columns])


def global_rank(df: DataFrame, *order: Column, rank: str = "rn", weight: str | None = None) -> DataFrame:
    """Exact 1-based global position without a one-partition window.

    Rows are range-partitioned on ``order``; each range is numbered by itself
    and shifted by the number of rows in the ranges before it. With ``weight``
    the running sum of that column is returned instead of the position. The
    order must be total for the numbering to be reproducible.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()),
        "rank",
    )
    step = F.lit(1) if weight is None else F.col(weight)
    # One row per range partition, so this table is bounded by the partition count.
    before = (
        placed.groupBy("_range")
        .agg(F.sum(step).alias("_rows"))
        .withColumn("_skip", F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_range", F.coalesce("_skip", F.lit(0)).alias("_skip"))
    )
    run = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_upto", F.sum(step).over(run))
        .join(F.broadcast(before), "_range")
        .withColumn(rank, (F.col("_upto") + F.col("_skip")).cast("long" if weight is None else "double"))
        .drop("_range", "_upto", "_skip")
    )


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Linear-interpolation quantiles of the non-null values of ``column``."""
    vals = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = vals.count()
    if n == 0:
        return [float("nan")] * len(probs)
    counts = vals.groupBy("x").agg(F.count("*").alias("c"))
    ranked = global_rank(counts, F.col("x"), rank="hi", weight="c")
    need = sorted({k for p in probs for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
    want = df.sparkSession.createDataFrame([(k,) for k in need], "k long")
    got = {
        r["k"]: r["x"]
        for r in ranked.join(F.broadcast(want), (F.col("k") < F.col("hi")) & (F.col("k") >= F.col("hi") - F.col("c"))).collect()
    }
    out = []
    for p in probs:
        pos = p * (n - 1)
        lo = int(pos)
        hi = min(lo + 1, n - 1)
        out.append(got[lo] + (got[hi] - got[lo]) * (pos - lo))
    return out
