"""Graph and sequence files."""

from __future__ import annotations

import shutil
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.graph import Graph


# Lines of a Pajek file written by one task.
PAJEK_LINES = 2_000_000


def save_graph(graph: Graph, path: str) -> None:
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def read_pajek(spark: SparkSession, path: str) -> Graph:
    """A ``*vertices`` / ``*edges`` file; a missing edge weight is 1.

    A line belongs to the edge part when it comes after the ``*edges`` line in
    its file, told by block start and row order within the block.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    head = lines.where(F.lower("value").startswith("*edges")).groupBy("f").agg(F.min("at").alias("cutoff"))
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.col("value").startswith("*") & (F.trim("value") != "")).join(head, "f", "left").select(
        parts.alias("p"), F.coalesce(F.col("at") > F.col("cutoff"), F.lit(False)).alias("edge"))
    edges = body.where("edge and size(p) > 1").select(
        F.col("p")[0].alias("s"), F.col("p")[1].alias("t"), F.coalesce(F.get("p", 2).cast("double"), F.lit(1.0)).alias("weight"))
    g = Graph.from_edges(edges, "s", "t", ("weight",))
    listed = body.where("not edge").select(F.col("p")[0].alias("node_id"))
    return Graph(listed.unionAll(g.vertices).distinct(), g.edges)


def write_pajek(graph: Graph, path: str, weight: str = "weight", lines: int = PAJEK_LINES) -> None:
    """Files of about ``lines`` lines, each with a ``*Vertices`` part before an ``*Edges`` part, so no task sorts the whole graph."""
    spark = graph.edges.sparkSession
    files = 1 + (graph.vertices.count() + graph.edges.count()) // lines
    rows = graph.vertices.select(F.lit(1).alias("o"), F.col("node_id").cast("string").alias("value")).unionAll(
        graph.edges.select(F.lit(3).alias("o"), F.concat_ws(" ", "u", "v", F.col(weight).cast("string")).alias("value")))
    rows = rows.select(F.pmod(F.xxhash64("value"), F.lit(files)).alias("p"), "o", "value")
    heads = spark.range(files).select(F.col("id").alias("p"), F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("value")) for o, x in ((0, "*Vertices"), (2, "*Edges"))])).alias("h"))
    every = rows.unionByName(heads.select("p", "h.o", "h.value"))
    every.repartitionByRange(files, "p").sortWithinPartitions("o").select("value").write.text(path)


def read_weighted_edges(spark: SparkSession, path: str) -> Graph:
    """Blank-separated ``u v weight`` lines."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(
        p[0].alias("s"), p[1].alias("t"), F.coalesce(F.get(p, 2).cast("double"), F.lit(1.0)).alias("weight"))
    return Graph.from_edges(rows, "s", "t", ("weight",))


def read_gml(spark: SparkSession, path: str) -> Graph:
    """Nodes by id and edges by source and target.

    A record is what stands in the brackets behind its keyword; brackets nested
    in it (up to four deep) and quoted text are passed over.
    """

    def records(keyword: str) -> DataFrame:
        opened = spark.read.option("lineSep", keyword).text(path).where(F.col("value").rlike(r"^\s*\["))
        # Without quotes and other brackets, as most are, a record ends where its bracket does.
        plain = F.expr("locate('\"', value) = 0 and locate('[', value, locate('[', value) + 1) = 0")
        short = F.expr("substring_index(substr(value, locate('[', value) + 1), ']', 1)")
        body = F.regexp_replace("value", r'"[^"]*"', '""')
        body = F.regexp_replace(body, r"^\s*\[", "")
        for _ in range(4):
            body = F.regexp_replace(body, r"\w+\s*\[[^\[\]]*\]", "")
        return opened.select(F.when(plain, short).otherwise(F.regexp_extract(body, r"^[^\[\]]*", 0)).alias("value"))

    def number(name: str):
        return F.nullif(F.regexp_extract("value", rf"\b{name}\s+(-?\d+)", 1), F.lit("")).cast("long")

    edges = records("edge").select(
        number("source").alias("s"), number("target").alias("t"),
        F.coalesce(F.nullif(F.regexp_extract("value", r"\b(?:weight|value)\s+(-?[\d.eE+-]+)", 1), F.lit("")).cast("double"), F.lit(1.0)).alias("weight")).where("s is not null and t is not null")
    g = Graph.from_edges(edges, "s", "t", ("weight",))
    nodes = records("node").select(number("id").alias("node_id")).where("node_id is not null")
    return Graph(nodes.unionAll(g.vertices).distinct(), g.edges)


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Reader chosen by suffix: .net/.txt, .dat, .gml, else a saved graph folder."""
    if path.endswith((".net", ".txt")):
        return read_pajek(spark, path)
    if path.endswith(".dat"):
        return read_weighted_edges(spark, path)
    return read_gml(spark, path) if path.endswith(".gml") else load_graph(spark, path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, sequence, record) per entry, plain or gzip.

    The id is the second '|' field of the header, else its first word.
    """
    rec = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    text = F.regexp_replace("value", r"^>", "")
    header = F.regexp_extract(text, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s+", "")
    by_bar = F.split_part(header, F.lit("|"), F.lit(2))
    entry = F.when(header.contains("|"), by_bar).otherwise(F.regexp_extract(F.trim(header), r"^(\S+)", 1))
    body = F.regexp_replace(text, r"\n+$", "")
    return rec.select(entry.alias("id"), header.alias("header"), seq.alias("sequence"), F.concat(F.lit(">"), body).alias("record"))


def split_fasta(entries: DataFrame, path: str) -> None:
    """One folder per id, skipping ids already there is left to :func:`open_jobs`."""
    entries.select("id", F.col("record").alias("value")).write.mode("append").partitionBy("id").text(path)


# The search command lines.
def _psiblast(fasta: str, db: str, out: str) -> list[str]:
    return ["psiblast", "-query", fasta, "-db", f"{db}/nr", "-num_iterations", "3", "-evalue", "0.001", "-matrix", "BLOSUM62", "-out_ascii_pssm", out]


def _hhblits(fasta: str, db: str, out: str) -> list[str]:
    return ["hhblits", "-i", fasta, "-d", f"{db}/UniRef30_2023_02", "-ohhm", out, "-cpu", "1", "-n", "2", "-v", "0"]


TOOLS = {"pssm": (_psiblast, ".pssm"), "hhm": (_hhblits, ".hhm")}


def open_jobs(entries: DataFrame, done: DataFrame, tool: str, fasta_dir: str, db: str, out_dir: str) -> DataFrame:
    """(id, command array) for entries without a result in ``done(id)``."""
    make, suffix = TOOLS[tool]
    words = make("{fasta}", db, "{out}")
    fasta = F.concat(F.lit(f"{fasta_dir}/"), F.col("id"), F.lit(".fasta"))
    out = F.concat(F.lit(f"{out_dir}/"), F.col("id"), F.lit(suffix))
    cmd = F.array(*[fasta if w == "{fasta}" else out if w == "{out}" else F.lit(w) for w in words])
    return entries.select("id").distinct().join(done.select("id").distinct(), "id", "left_anti").select("id", cmd.alias("command"))


def run_jobs(jobs: DataFrame) -> DataFrame:
    """(id, code): run each command in a task; -1 where the tool is not installed."""

    def run(batches):
        for pdf in batches:
            codes = [subprocess.run(list(c), capture_output=True).returncode if shutil.which(c[0]) else -1 for c in pdf.command]
            yield pd.DataFrame({"id": pdf.id, "code": codes})

    return jobs.mapInPandas(run, "id string, code int")
