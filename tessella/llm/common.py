"""Tables, scratch tables and the query registry of the subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import scratch_path, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register an ``opN_`` query and, where there is one, its DuckDB SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go.

    They go when the driver no longer holds the step's plan and its JVM collects
    garbage, which a driver with little to do rarely does by itself.
    """
    gc.collect()
    for _ in range(2):  # what the first round finalizes, the second one frees
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends and its size is known to the planner."""
    spark = df.sparkSession
    release(spark)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, divisor: int) -> Column:
    """Remainder of the CRC-32 of the column's decimal text; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")
