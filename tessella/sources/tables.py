"""Delimited, JSON and spreadsheet readers, result sinks, lookup tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.residues import parse_list


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A headed delimited file, columns taken by name; NaN becomes null.

    gzip files are read as they are, one task per file.
    """
    heads = spark.read.option("header", "true").option("sep", sep).csv(path)
    picked = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in heads.columns else F.lit(None)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.lower(c) != "nan", c)
        picked.append(c.try_cast(f.dataType).alias(f.name))
    return heads.select(*picked)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Codon-context table whose lists are written as literals."""
    from tessella.sources.schemas import CODON_CONTEXTS

    df = read_csv(spark, path, CODON_CONTEXTS)
    lists = ("ensmbl_id", "cds_contexts", "unique_cds_contexts")
    return df.withColumns({c: F.when(F.col(c).isNotNull(), parse_list(F.col(c))) for c in lists})


def read_substitution_model(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(ctx, mut, freq) from a nested JSON object, below ``key`` if given."""
    kind = "map<string,map<string,double>>"
    text = spark.read.text(path, wholetext=True)
    if key is None:
        m = F.from_json("value", kind)
    else:
        m = F.from_json(F.from_json("value", "map<string,string>")[key], kind)
    outer = text.select(F.explode(m).alias("ctx", "m"))
    return outer.select("ctx", F.explode("m").alias("mut", "freq"))


def read_label_map(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(label, idx) of one column of a ``{column: {label: index}}`` JSON file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")[column]).alias("label", "idx"))


def write_label_map(mapping: DataFrame, column: str, path: str) -> None:
    """Store (label, idx) as one JSON object per row under the column's name; read back by Spark at any size."""
    mapping.select(F.lit(column).alias("column"), "label", "idx").write.mode("overwrite").partitionBy("column").json(path)


def label_map(df: DataFrame, column: str, path: str) -> DataFrame:
    """The stored mapping of a column, or one fitted on ``df`` and stored."""
    from tessella.operators.encode import fit_labels

    spark = df.sparkSession
    try:
        stored = spark.read.schema("label string, idx int, column string").json(path).where(F.col("column") == column)
        if stored.take(1):
            return stored.select("label", "idx")
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fitted = fit_labels(df, column)
    fitted.select(F.lit(column).alias("column"), "label", "idx").write.mode("append").partitionBy("column").json(path)
    return fitted


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes):
    """Rows of the first sheet of a workbook as lists of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_NS}c"):
                col = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A")).group():
                    col = col * 26 + ord(ch) - 64
                v = c.find(f"{_NS}v")
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t")) or None
                cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells) + 1)] if cells else []


def read_workbook(spark: SparkSession, path: str, schema: T.StructType, skip: int = 0) -> DataFrame:
    """First sheet of one or more .xlsx files, one task per file; the row after ``skip`` holds the names."""
    names = schema.fieldNames()

    def rows(batches):
        for pdf in batches:
            for content in pdf.content:
                it = iter(_sheet_rows(content))
                for _ in range(skip):
                    next(it, None)
                head = next(it, [])
                at = {n: head.index(n) for n in names if n in head}
                out = [[r[at[n]] if n in at and at[n] < len(r) else None for n in names] for r in it if r]
                yield pd.DataFrame(out, columns=names, dtype=object)

    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    files = spark.read.format("binaryFile").load(path).select("content")
    text = files.mapInPandas(rows, raw)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert_results(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Result rows (Measure, Value) with the new value winning."""
    if old is None:
        return new
    seq = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return seq.groupBy("Measure").agg(F.max_by("Value", "_s").alias("Value"))


def write_clusters(clusters: DataFrame, path: str, run_id: str, measure: str) -> None:
    """Store a cluster set under its run."""
    clusters.withColumn("run_id", F.lit(run_id)).withColumn("measure", F.lit(measure)).write.mode("append").partitionBy("measure", "run_id").parquet(path)


def lookup_names(df: DataFrame, names: DataFrame, key: str, name: str, default_key: bool = True) -> DataFrame:
    """Left join of a name table; ids without a name keep the id."""
    out = df.join(names.select(key, name), key, "left")
    return out.withColumn(name, F.coalesce(name, key)) if default_key else out
