"""Node tables: attribute mapping, joins, codon contexts, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.codons import context_5nt, context_scores
from tessella.functions.residues import parse_node_id, split_node_id
from tessella.graph import Graph
from tessella.runtime import cut, no_rows, with_scalars


def join_features(base: DataFrame, *others: DataFrame, key: str = "node_id") -> DataFrame:
    """Left-join feature tables on the node id; overlapping columns get _x (left) and _y (right)."""
    out = base
    for other in others:
        both = [c for c in other.columns if c in out.columns and c != key]
        left = out.withColumnsRenamed({c: f"{c}_x" for c in both})
        out = left.join(other.withColumnsRenamed({c: f"{c}_y" for c in both}), key, "left")
    return out


def with_id_parts(df: DataFrame, node_id: str = "node_id") -> DataFrame:
    return df.withColumns(split_node_id(F.col(node_id)))


def map_attributes(graph: Graph, table: DataFrame, columns: list[str]) -> DataFrame:
    """Vertices with table columns; nodes absent from the table get 0.

    ``has_mutation`` is 1 where the count differs from 0, and also where the
    node is listed with a null count, which is taken as unequal to 0. A repeated node id is an error.
    """
    repeated = table.groupBy("node_id").count().where("count > 1")
    if not no_rows(repeated):
        raise ValueError("node_id is not unique in the attribute table")
    picked = table.select("node_id", *columns, F.lit(1).alias("_listed"))
    base = graph.vertices.drop(*columns)
    joined = base.join(picked, "node_id", "left")
    absent = F.col("_listed").isNull()
    count = F.col("total_mutations_count") if "total_mutations_count" in columns else F.lit(0)
    flag = F.when(absent, 0).when(count.isNull(), 1).when(count != 0, 1).otherwise(0)
    joined = joined.withColumn("has_mutation", flag.cast("int"))
    return joined.withColumns({c: F.when(absent, F.lit(0)).otherwise(F.col(c)) for c in columns}).drop("_listed")


def merge_measures(vertices: DataFrame, measures: dict[str, DataFrame], keep: list[str]) -> DataFrame:
    """Join per-measure node tables onto the vertices under canonical names.

    A table whose node set differs from the graph's is refused, as is a wanted
    measure that no table supplies.
    """
    renamed = {canonical_measure(name): (name, t) for name, t in measures.items()}
    missing = [k for k in keep if k not in renamed]
    if missing:
        raise ValueError(f"no table for {missing}")
    out = vertices.select("node_id")
    for name in keep:
        source, t = renamed[name]
        if not no_rows(vertices.join(t, "node_id", "left_anti")) or not no_rows(t.join(vertices, "node_id", "left_anti")):
            raise ValueError(f"node set of {source} differs from the graph")
        value = source if source in t.columns else [c for c in t.columns if c != "node_id"][0]
        out = out.join(t.select("node_id", F.col(value).alias(name)), "node_id")
    return out


def canonical_measure(name: str) -> str:
    if "shortest_path" in name:
        return "shortest_path_length"
    return "closeness_centrality" if "closeness" in name and "flow" not in name else name


def normalize(df: DataFrame, targets: list[str], method: str = "minmax") -> DataFrame:
    """Min-max or z-score (population deviation); nulls count as 0, a flat column becomes x - min (mean)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in targets})
    if method not in ("minmax", "zscore"):
        return filled
    aggs = []
    for c in targets:
        low, span = (F.min(c), F.max(c) - F.min(c)) if method == "minmax" else (F.avg(c), F.stddev_pop(c))
        aggs += [low.alias(f"_lo_{c}"), span.alias(f"_sp_{c}")]
    scaled = with_scalars(filled, filled.agg(*aggs))
    for c in targets:
        shift = F.col(c) - F.col(f"_lo_{c}")
        scaled = scaled.withColumn(c, F.when(F.col(f"_sp_{c}") == 0, shift).otherwise(shift / F.col(f"_sp_{c}")))
    return scaled.select(*df.columns)


def node_contexts(nodes: DataFrame, xref: DataFrame, proteins: DataFrame, cds: DataFrame) -> DataFrame:
    """Codon contexts of each node over its matching transcripts.

    ``xref(uniprot_id, ensp)``, ``proteins(ensp, enst, pseq)``, ``cds(enst, seq)``.
    A transcript matches when its protein carries the node's residue at the
    node's position. Output: node_id, ensmbl_id, cds_contexts (nulls kept,
    aligned with ensmbl_id) and unique_cds_contexts, all null without a match.
    """
    ids = nodes.select("node_id").distinct().withColumn("p", parse_node_id(F.col("node_id"))).select("node_id", "p.*")
    hit = (
        ids.where("uniprot_id is not null and aa1 is not null and position > 0")
        .join(xref, "uniprot_id")
        .join(proteins.where(F.col("enst").startswith("ENST")), "ensp")
        .where("position <= length(pseq) and substring(upper(pseq), position, 1) = aa1")
        .select("node_id", "position", "enst")
        .distinct()
    )
    seqs = cds.select(F.col("enst"), F.upper("seq").alias("seq"))
    ctx = hit.join(seqs, "enst", "left").select("node_id", "enst", context_5nt(F.col("seq"), F.col("position")).alias("c"))
    # One entry per transcript of one protein: a handful, not a data-sized group.
    grouped = ctx.groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.struct("enst", "c"))).alias("_t"), F.array_sort(F.collect_set("c")).alias("_u")
    )
    return nodes.select("node_id").join(grouped, "node_id", "left").select(
        "node_id",
        F.col("_t.enst").alias("ensmbl_id"),
        F.col("_t.c").alias("cds_contexts"),
        F.when(F.size("_u") > 0, F.col("_u")).alias("unique_cds_contexts"),
    )


def mutability(contexts: DataFrame, model: DataFrame) -> DataFrame:
    """(node_id, mutability): context scores weighted by their share of all transcripts.

    Null contexts count in the denominator. Null without any context, 0 for an
    empty list.
    """
    contexts = cut(contexts, "contexts")  # read three times below
    rows = contexts.where("unique_cds_contexts is not null").select(
        "node_id", F.size("cds_contexts").alias("total"), F.explode_outer("cds_contexts").alias("context")
    )
    scored = rows.join(context_scores(rows, model), "context", "left")
    per_node = scored.groupBy("node_id").agg(
        (F.sum(F.when(F.col("context").isNotNull(), F.col("score"))) / F.max("total")).alias("s")
    )
    return contexts.select("node_id", "unique_cds_contexts").join(per_node, "node_id", "left").select(
        "node_id",
        F.when(F.col("unique_cds_contexts").isNotNull(), F.coalesce("s", F.lit(0.0))).alias("mutability"),
    )


def copy_numbers(df: DataFrame, parity: bool = False) -> DataFrame:
    """(uniprot_id, copy_num): greatest copy index + 1, or 1 without copies.

    ``parity`` folds the copy indices in ascending order, taking index + 1 only
    when the index exceeds the value held, so copies 1, 2 give 2.
    """
    part = F.split_part(F.split_part("node_id", F.lit("_"), F.lit(1)), F.lit("-"), F.lit(2))
    idx = F.when(part != "", part.cast("int"))
    if not parity:
        return df.groupBy("uniprot_id").agg((F.coalesce(F.max(idx), F.lit(0)) + 1).cast("int").alias("copy_num"))
    # Distinct copy indices of one protein: the chains of an assembly.
    seen = df.groupBy("uniprot_id").agg(F.array_sort(F.collect_set(idx)).alias("_c"))
    fold = F.aggregate(
        "_c", F.lit(None).cast("int"),
        lambda acc, x: F.when(acc.isNull() | (x > acc), x + 1).otherwise(acc),
    )
    return seen.select("uniprot_id", F.coalesce(fold, F.lit(1)).alias("copy_num"))


def normalized_counts(df: DataFrame, copies: DataFrame) -> DataFrame:
    """Node and mutated-node counts per protein, divided by its copy number."""
    total = df.groupBy("uniprot_id").agg(
        F.count("*").alias("raw_total"), F.coalesce(F.sum((F.col("is_mut") == 1).cast("long")), F.lit(0)).alias("raw_mut")
    )
    n = F.coalesce("copy_num", F.lit(1))
    return (
        total.join(copies, "uniprot_id", "left")
        .withColumn("copy_num", n)
        .withColumn("norm_total", F.col("raw_total") / n)
        .withColumn("norm_mut", F.col("raw_mut") / n)
        .withColumn("norm_other", F.col("norm_total") - F.col("norm_mut"))
    )


def align_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Outer join of two count tables (key, n), missing counts as 0."""
    return left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), key, "full").select(
        key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n): equal-width counts over [min, max], the last bin closed on the right."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    s = with_scalars(x, x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    b: Column = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))
    )
    return s.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def linear_fit(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, slope, intercept, r) of target on each feature over complete pairs.

    All features are fitted in one pass over the table.
    """
    long = df.select(
        F.col(target).cast("double").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p"),
    ).select("y", "p.feature", "p.x").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return long.groupBy("feature").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"),
    )
