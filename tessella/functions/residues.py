"""Residue and node-id expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three-letter and one-letter residue codes.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G",
    "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S",
    "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "SEC": "U", "PYL": "O",
}
# Fixed value: the shape of a node id.
NODE_ID = r"^([A-Za-z0-9\-]+)_(-?\d+)_([A-Za-z]{3})$"


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def residue_3to1(code: Column) -> Column:
    return literal_map(THREE_TO_ONE)[F.upper(code)]


def residue_1to3(code: Column) -> Column:
    return literal_map({v: k for k, v in THREE_TO_ONE.items()})[F.upper(code)]


def strip_copy_index(protein: Column) -> Column:
    return F.regexp_replace(F.lower(protein), r"-\d+$", "")


def parse_node_id(node_id: Column) -> Column:
    """struct(uniprot_id upper case without copy, position, aa1); nulls where the id is malformed."""
    text = F.trim(node_id)
    ok = text.rlike(NODE_ID)

    def part(i: int) -> Column:
        return F.when(ok, F.regexp_extract(text, NODE_ID, i))

    return F.struct(
        F.upper(strip_copy_index(part(1))).alias("uniprot_id"),
        part(2).cast("int").alias("position"),
        residue_3to1(part(3)).alias("aa1"),
    )


def split_node_id(node_id: Column) -> dict[str, Column]:
    """position, residueType, uniprot_id and copyindex (null without a copy) as text."""
    head = F.split_part(node_id, F.lit("_"), F.lit(1))
    return {
        "position": F.split_part(node_id, F.lit("_"), F.lit(2)),
        "residueType": F.split_part(node_id, F.lit("_"), F.lit(3)),
        "uniprot_id": F.split_part(head, F.lit("-"), F.lit(1)),
        "copyindex": F.nullif(F.split_part(head, F.lit("-"), F.lit(2)), F.lit("")),
    }


def parse_list(text: Column, fallback_single: bool = False) -> Column:
    """A list literal such as ``['a', None]`` as array<string>; [] (or [text]) where it does not parse."""
    parsed = F.from_json(F.regexp_replace(text, r"\bNone\b", "null"), "array<string>", {"allowSingleQuotes": "true"})
    other = F.array(text) if fallback_single else F.array().cast("array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, other))


def parse_ids(ids: Column) -> Column:
    """Accession array without version suffixes."""
    return F.transform(ids, lambda x: F.split_part(x, F.lit("."), F.lit(1)))


def gene_names(ids: Column, names: Column) -> Column:
    """Each id replaced by its name in the map ``names``, or kept."""
    return F.transform(ids, lambda x: F.coalesce(names[x], x))


def stratum_label(mode: str, residue: str = "residue_name", bin_col: str = "bin_mutability") -> Column:
    """Sampling stratum: 'mut+res', 'res', 'mut', anything else is a single stratum '0'."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    if mode == "mut+res":
        return F.concat_ws("_", text(residue), text(bin_col))
    if mode == "res":
        return text(residue)
    if mode == "mut":
        return text(bin_col)
    return F.lit("0")
