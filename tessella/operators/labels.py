"""Driver-label sources and their mapping to nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.residues import parse_ids, residue_1to3

# How a residue change is written in each source.
CDNA_CHANGE = r"c.(\d+)([A-Z])"
RESIDUE_CHANGE = r"([A-Z])(\d+)"
PROTEIN_CHANGE = r"p\.([A-Z])(\d+)"


def _change(text: Column, pattern: str, pos_group: int, res_group: int) -> tuple[Column, Column]:
    ok = text.rlike(pattern)
    pos = F.when(ok, F.regexp_extract(text, pattern, pos_group).cast("int"))
    res = F.when(ok, F.lower(residue_1to3(F.regexp_extract(text, pattern, res_group))))
    return pos, res


def _status(df: DataFrame, label: Column) -> DataFrame:
    """(enst, pos, res, is_driver): 1 where any row of the key is labelled; null keys are dropped."""
    kept = df.where("enst is not null and pos is not null and res is not null")
    return kept.groupBy("enst", "pos", "res").agg(F.max(label.cast("int")).alias("is_driver"))


def cosmic_status(df: DataFrame, threshold: float) -> DataFrame:
    """Rows scored above the threshold (given as a share or in percent) make a position a driver."""
    th = threshold / 100 if threshold > 1 else threshold
    pos, res = _change(F.col("Mutation CDS"), CDNA_CHANGE, 1, 2)
    score = F.col("FATHMM score")
    rows = df.where(score.isNotNull() & ~F.isnan(score) & F.col("Accession Number").startswith("ENST"))
    rows = rows.select(F.col("Accession Number").alias("enst"), pos.alias("pos"), res.alias("res"), (score > th).alias("hit"))
    return _status(rows, F.col("hit"))


def mutagene_status(df: DataFrame) -> DataFrame:
    """Driver/Passenger rows keyed by the first ENST of the ';' list."""
    parts = F.transform(F.split("Transcript ID", ";"), lambda p: F.trim(p))
    enst = F.get(F.filter(parts, lambda p: p.startswith("ENST")), 0)
    label = F.when(F.col("label") == "Driver", 1).when(F.col("label") == "Passenger", 0)
    pos, res = _change(F.col("mutation"), RESIDUE_CHANGE, 2, 1)
    rows = df.select(enst.alias("enst"), pos.alias("pos"), res.alias("res"), label.alias("hit")).where("hit is not null")
    return _status(rows, F.col("hit"))


def chasmplus_status(df: DataFrame) -> DataFrame:
    """Every listed change is a driver."""
    pos, res = _change(F.col("mutation"), PROTEIN_CHANGE, 2, 1)
    rows = df.select(F.col("Transcript ID").alias("enst"), pos.alias("pos"), res.alias("res"), F.lit(1).alias("hit"))
    return _status(rows, F.col("hit"))


def merge_status(*sources: DataFrame) -> DataFrame:
    """(enst, pos, res, status): mean label over the sources that list the key."""
    union = reduce(DataFrame.unionByName, sources)
    return union.groupBy("enst", "pos", "res").agg(F.avg("is_driver").alias("status"))


def map_driver_status(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Nodes that some source lists, with ``is_driver`` 1 if any of their transcripts is a driver.

    ``nodes`` needs node_id, ensmbl_id (array), position and residueType.
    """
    long = nodes.select(
        "node_id", F.col("position").try_cast("int").alias("pos"), F.col("residueType").alias("res"),
        F.explode(parse_ids(F.col("ensmbl_id"))).alias("enst"),
    )
    found = long.join(status, ["enst", "pos", "res"]).groupBy("node_id").agg(
        F.max((F.col("status") > 0).cast("int")).alias("is_driver")
    )
    return nodes.join(found, "node_id")


def combine_labelled(*frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bag union of labelled frames with one row per key."""
    from tessella.operators.edges import dedupe_first

    return dedupe_first(reduce(DataFrame.unionByName, frames), list(keys))
