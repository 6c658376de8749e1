"""Contact-edge cleaning: ids, filters, symmetric merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import exact_quantiles

# The per-contact energy columns that are averaged on merge.
ENERGY_COLUMNS = (
    "coulombs_energy",
    "lj_energy",
    "total_energy",
    "cleaned_lj_energy",
    "cleaned_total_energy",
)


def _keys(table: DataFrame, column: str, as_name: str, lower: bool = False) -> DataFrame:
    c = F.col(f"`{column}`")
    return table.select((F.lower(c) if lower else c).alias(as_name)).where(F.col(as_name).isNotNull()).distinct()


def add_node_ids(df: DataFrame) -> DataFrame:
    """Node id ``uniprot-copy_position_residue`` (lower case) and base protein id per side."""
    out = df
    for i in ("1", "2"):
        pieces = (F.regexp_replace(f"uniprot{i}", "_", "-"), F.col(f"pdb_auth_resi{i}").cast("string"), F.col(f"res3n{i}"))
        # A missing piece is spelled 'nan' so that the id stays readable and non-null.
        node = F.lower(F.concat_ws("_", *[F.coalesce(p, F.lit("nan")) for p in pieces]))
        out = out.withColumn(f"nodeid_{i}", node).withColumn(
            f"remove_homo_uniprot{i}", F.split_part(f"uniprot{i}", F.lit("_"), F.lit(1))
        )
    return out


def keep_listed_proteins(df: DataFrame, excluded_pdb: DataFrame, included: DataFrame) -> DataFrame:
    """Drop excluded structures, then keep edges whose two base proteins are listed.

    The lists are lower-cased, ``pdb_code`` is compared as it stands; a null
    ``pdb_code`` is kept.
    """
    out = df.join(_keys(excluded_pdb, "0", "pdb_code", lower=True), "pdb_code", "left_anti")
    for side in ("remove_homo_uniprot1", "remove_homo_uniprot2"):
        out = out.join(_keys(included, "uniprot", side, lower=True), side, "left_semi")
    return out.select(*df.columns)


def drop_blocked_proteins(df: DataFrame, blocked: list[str]) -> DataFrame:
    """Drop edges touching an id of a short literal list; null ids are kept."""
    def hit(c: str) -> Column:
        return F.coalesce(F.col(c).isin(blocked), F.lit(False))

    return df.where(~hit("uniprot1") & ~hit("uniprot2"))


def keep_listed_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep edges whose two node ids are in ``nodes(node_id)``."""
    out = df
    for side in ("nodeid_1", "nodeid_2"):
        out = out.join(_keys(nodes, "node_id", side), side, "left_semi")
    return out.select(*df.columns)


def keep_positive_positions(df: DataFrame) -> DataFrame:
    return df.where("try_cast(pdb_auth_resi1 as int) > 0 and try_cast(pdb_auth_resi2 as int) > 0")


def keep_inter_chain(df: DataFrame) -> DataFrame:
    return df.where((F.col("chain_flag") == "inter-chain") & (F.col("remove_homo_uniprot1") != F.col("remove_homo_uniprot2")))


def drop_homodimer_copies(df: DataFrame) -> DataFrame:
    return df.where(~F.col("nodeid_1").contains("-") & ~F.col("nodeid_2").contains("-"))


def drop_missing_energy(df: DataFrame, column: str = "cleaned_total_energy") -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c))


def unique_endpoints(df: DataFrame) -> DataFrame:
    """(node_id) over both sides, once each; the table is read once."""
    return df.select(F.explode(F.array("nodeid_1", "nodeid_2")).alias("node_id")).distinct()


def merge_symmetric(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per unordered pair: mean energies, first non-null of the rest.

    Only the ids are swapped; other per-side columns stay as they are. "First"
    is the row least in ``order_by`` (by default all other columns), because a
    distributed table has no row order. Pairs without energy are dropped.
    """
    a, b = F.col("nodeid_1"), F.col("nodeid_2")
    rest = [c for c in df.columns if c not in ("nodeid_1", "nodeid_2") and c not in ENERGY_COLUMNS]
    energies = [c for c in df.columns if c in ENERGY_COLUMNS]
    order = F.struct(*(order_by or rest)) if (order_by or rest) else F.lit(0)
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    # nanvl: an energy read as NaN counts as missing.
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in energies]
    merged = (
        df.withColumns({"nodeid_1": F.least(a, b), "nodeid_2": F.greatest(a, b)})
        .groupBy("nodeid_1", "nodeid_2")
        .agg(*means, *picks)
    )
    return merged.select(*df.columns).where(F.col("cleaned_total_energy").isNotNull())


def dedupe_first(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key, the least by ``order_by`` (by default all other columns)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = F.struct(*[F.col(c) for c in (order_by or rest)])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def drop_repulsive(edges: DataFrame, weight: str = "weight", with_zero: bool = False) -> DataFrame:
    """Edges that attract: weight <= 0, or < 0 when zeros count as repulsive."""
    w = F.col(weight)
    return edges.where(w < 0 if with_zero else w <= 0)


def drop_weak_or_repulsive(edges: DataFrame, percentile: int = 25, weight: str = "weight") -> DataFrame:
    """Keep attracting edges stronger than the given percentile of abs(weight)."""
    size = edges.select(F.abs(weight).alias("s"))
    bound = exact_quantiles(size, "s", [int(percentile) / 100.0])[0]
    return edges.where((F.abs(weight) > F.lit(bound)) & (F.col(weight) < 0))
