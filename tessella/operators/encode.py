"""Feature encodings: bins, indices, indicators, tensors as arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.residues import literal_map, parse_list
from tessella.runtime import exact_quantiles, global_rank, no_rows, with_scalars

# Which columns take which encoding.
CATEGORICAL = (
    "uniprot_id", "mut+res-bin", "dssp_sec_struct", "dssp_helix_3_10", "dssp_helix_alpha", "dssp_helix_pi",
    "dssp_helix_pp", "dssp_sheet", "dssp_strand", "dssp_ladder_1", "dssp_ladder_2",
)
ANGULAR = ("dssp_alpha", "dssp_phi", "dssp_psi")
NUMERIC_FILL = {"dssp_accessibility": -1, "dssp_TCO": -2, "dssp_kappa": -1}
ZERO_FILLED = ("unique_patients_count", "total_mutations_count", "unique_mutation_types_count")


def equal_width_bins(df: DataFrame, column: str, out: str, bins: int = 42) -> DataFrame:
    """0-based right-closed equal-width bins, the lowest value in bin 0; null stays null."""
    x = F.col(column).cast("double")
    s = with_scalars(df, df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx")))
    mn, mx = F.col("_mn"), F.col("_mx")
    # A constant column is widened evenly on both sides, which puts it in the middle.
    flat = F.lit((bins + 1) // 2 - 1)
    # The quotient may miss the bin by a rounding step, so the edges mn + i * width decide; the last edge is the maximum.
    width = (mx - mn) / bins
    near = F.ceil((x - mn) / width) - 1
    near = near + F.when(x > mn + (near + 1) * width, 1).when(x <= mn + near * width, -1).otherwise(0)
    b = F.when(mx == mn, flat).otherwise(F.least(F.greatest(near, F.lit(0)), F.lit(bins - 1)))
    return s.withColumn(out, F.when(x.isNotNull(), b.cast("int"))).select(*df.columns, out)


def quantile_bins(df: DataFrame, column: str, out: str, bins: int = 42) -> DataFrame:
    """0-based right-closed quantile bins; equal edges are merged."""
    edges = exact_quantiles(df, column, [i / bins for i in range(bins + 1)])
    inner = sorted(set(edges))[1:-1]
    x = F.col(column).cast("double")
    above: Column = F.lit(0)
    for e in inner:
        above = above + F.when(x > F.lit(e), 1).otherwise(0)
    return df.withColumn(out, F.when(x.isNotNull(), above.cast("int")))


def angular(feature: str) -> dict[str, Column]:
    """Missing flag, sine and cosine of an angle in degrees; 0 where missing."""
    x = F.col(feature).cast("double")
    missing = x.isNull() | F.isnan(x)
    rad = F.radians(x)
    return {
        f"{feature.replace('dssp_', '')}_is_na": missing.cast("int"),
        f"{feature}_sin": F.when(missing, 0.0).otherwise(F.sin(rad)),
        f"{feature}_cos": F.when(missing, 0.0).otherwise(F.cos(rad)),
    }


def numeric_with_flag(feature: str) -> dict[str, Column]:
    x = F.col(feature).cast("double")
    missing = x.isNull() | F.isnan(x)
    flag = "tco_is_na" if "TCO" in feature else feature.replace("dssp_", "").lower() + "_is_na"
    return {flag: missing.cast("int"), feature: F.when(missing, float(NUMERIC_FILL[feature])).otherwise(x)}


def bend() -> Column:
    return F.coalesce(F.when(F.col("dssp_bend") == "S", 1), F.lit(0))


def chirality() -> Column:
    c = F.col("dssp_chirality")
    return F.coalesce(F.when(c == "-", 1).when(c == "+", 2), F.lit(0))


def modification_columns(df: DataFrame, column: str = "ptms_mapped", limit: int = 2000) -> tuple[DataFrame, list[str]]:
    """Multi-hot columns ``ptm_*`` over the sorted vocabulary, and ``ptm_is_na`` for an empty list.

    The vocabulary becomes columns, so its size is checked before it is fetched.
    """
    is_text = dict(df.dtypes)[column] == "string"
    items = parse_list(F.col(column)) if is_text else F.coalesce(F.col(column), F.array().cast("array<string>"))
    work = df.withColumn("_items", items)
    vocab = work.select(F.explode("_items").alias("x")).distinct()
    words = [r["x"] for r in vocab.orderBy("x").limit(limit + 1).collect()]
    if len(words) > limit:
        raise ValueError(f"more than {limit} distinct values cannot become columns")
    cols = {f"ptm_{w}": F.array_contains("_items", w).cast("int") for w in words}
    cols["ptm_is_na"] = (F.size("_items") == 0).cast("int")
    return work.withColumns(cols).drop("_items", column), list(cols)


def scale_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """Undo log scales of two substitution scores, fill missing counts with 0, flag missing mutations."""
    out = df
    for f in features:
        c = F.col(f).cast("double")
        if "DAYM780301" in f:
            out = out.withColumn(f, F.coalesce(F.pow(F.lit(10.0), c / 10), F.lit(0.0)))
        elif "HENS920102" in f:
            out = out.withColumn(f, F.coalesce(F.pow(F.lit(2.0), c / 3), F.lit(0.0)))
        elif any(z in f for z in ZERO_FILLED):
            if "total_mutations_count" in f:
                out = out.withColumn("mut_is_na", F.col(f).isNull().cast("int"))
            out = out.withColumn(f, F.coalesce(F.col(f), F.lit(0)))
    return out


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """(label, idx): 'Unknown' is 0, the other labels 1..k in sorted order.

    Fitted on the whole table. The position is taken range by range, so the
    vocabulary may be as long as the table.
    """
    labels = df.select(F.col(f"`{column}`").cast("string").alias("label")).where("label is not null and label <> 'Unknown'").distinct()
    ranked = global_rank(labels, F.col("label"), rank="idx").select("label", F.col("idx").cast("int").alias("idx"))
    unknown = df.sparkSession.createDataFrame([("Unknown", 0)], "label string, idx int")
    return ranked.unionByName(unknown)


def apply_labels(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a column by its index; null and unseen labels become the index of 'Unknown'."""
    m = mapping.select(F.col("label").alias("_l"), F.col("idx").alias("_i"))
    key = F.col(f"`{column}`").cast("string")
    return df.join(m, key == F.col("_l"), "left").withColumn(column, F.coalesce("_i", F.lit(0))).drop("_l", "_i")


def apply_fixed_labels(df: DataFrame, column: str, mapping: dict[str, int]) -> DataFrame:
    """As :func:`apply_labels`, for a short vocabulary given as a dict."""
    key = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("Unknown"))
    return df.withColumn(column, F.coalesce(literal_map(mapping)[key], F.lit(mapping.get("Unknown", 0))))


@dataclass(frozen=True)
class Encoded:
    table: DataFrame
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)


def encode_features(df: DataFrame, features: list[str], mappings: dict[str, DataFrame] | None = None,
                    passthrough_numeric: bool = False) -> Encoded:
    """Encode the named columns.

    Plain numeric columns are left out of ``numeric`` unless
    ``passthrough_numeric`` is set. Missing label mappings are fitted on ``df``.
    """
    out, cats, nums = df, [], []
    for f in features:
        if f in CATEGORICAL:
            mapping = (mappings or {}).get(f)
            out = apply_labels(out, f, mapping if mapping is not None else fit_labels(df, f))
            cats.append(f)
        elif f in ANGULAR or f in NUMERIC_FILL:
            new = angular(f) if f in ANGULAR else numeric_with_flag(f)
            out = out.withColumns(new)
            nums += list(new)
        elif f == "dssp_bend":
            out = out.withColumn(f, bend())
            nums.append(f)
        elif f == "dssp_chirality":
            out = out.withColumn(f, chirality())
            nums.append(f)
        elif f == "ptms_mapped":
            out, new_cols = modification_columns(out)
            nums += new_cols
        elif passthrough_numeric:
            nums.append(f)
    return Encoded(out, cats, nums)


def assemble(vertices: DataFrame, encoded: Encoded, graph_features: list[str] | None = None,
             label: str | None = None, constant: bool = False) -> DataFrame:
    """(node_id, x, x_cat, y): graph features, then numeric table features, then an optional 1.

    Every vertex must have a feature row.
    """
    t = encoded.table
    absent = vertices.join(t, "node_id", "left_anti")
    if not no_rows(absent):
        raise ValueError("some graph nodes have no feature row")
    xs = [F.col(f"g.`{c}`") for c in (graph_features or [])] + [F.col(f"t.`{c}`") for c in encoded.numeric]
    if constant:
        xs.append(F.lit(1.0))
    if not xs and not encoded.categorical:
        raise ValueError("no features given")
    picked = [F.array(*[c.cast("double") for c in xs]).alias("x")]
    picked.append(F.array(*[F.col(f"t.`{c}`").cast("int") for c in encoded.categorical]).cast("array<int>").alias("x_cat"))
    if label:
        picked.append(F.col(f"t.`{label}`").cast("long").alias("y"))
    return vertices.alias("g").join(t.alias("t"), "node_id").select("node_id", *picked)


def add_constant(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.concat("x", F.array(F.lit(1.0))))


def feature_names(encoded: Encoded, graph_features: list[str] | None = None, constant: bool = False) -> list[str]:
    """Names in the order of ``x``; look a feature up here, never by a guessed position."""
    return [*(graph_features or []), *encoded.numeric, *(["constant"] if constant else [])]


def feature_index(names: list[str], target: str) -> int | None:
    """Position of a feature by name, or by the loose rule for mutation counts."""
    if target in names:
        return names.index(target)
    if "total_mutation" in target.lower():
        for i, n in enumerate(names):
            if "total_mutation" in n.lower() and "count" in n.lower():
                return i
    return None
