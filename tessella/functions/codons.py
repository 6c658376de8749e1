"""Coding-sequence expressions and the per-context substitution table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.residues import literal_map

# Fixed value: the standard genetic code, amino acids in TCAG order ('_' is stop).
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODON_TABLE = {"".join(c): a for c, a in zip(product(_BASES, repeat=3), _AMINO)}


def translate_codon(codon: Column) -> Column:
    return F.coalesce(literal_map(CODON_TABLE)[codon], F.lit("X"))


def context_5nt(cds: Column, position: Column) -> Column:
    """The codon at a 1-based residue position with one base on each side.

    Null where a flanking base is missing, so always null at position 1.
    """
    first = (position - 1) * 3
    return F.when((position > 1) & (first + 4 <= F.length(cds)), F.substring(cds, first, F.lit(5)))


def context_scores(contexts: DataFrame, model: DataFrame, column: str = "context") -> DataFrame:
    """(context, score): summed frequency of amino-acid changing substitutions.

    ``contexts`` holds 5-base contexts (at most 4^5 distinct ones matter, so the
    model never meets a long table); ``model(ctx, mut, freq)`` gives the
    frequency of triplet ``ctx`` turning into ``mut`` (middle base changed).
    A context that is not 5 long scores 0.
    """
    ctx = F.col("context")
    distinct = contexts.select(F.col(column).alias("context")).where(ctx.isNotNull()).distinct()
    shifted = distinct.where(F.length(ctx) == 5).select(
        "context", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    ).withColumn("ctx", F.substring(ctx, F.col("k"), F.lit(3)))
    base = F.substring("mut", 2, 1)
    codon = F.substring(ctx, F.lit(2), F.lit(3))
    k = F.col("k")
    changed = F.concat(F.substring(codon, F.lit(1), k - 1), base, F.substring(codon, k + 1, F.lit(3)))
    hit = translate_codon(changed) != translate_codon(codon)
    scored = shifted.join(model, "ctx").where(hit).groupBy("context").agg(F.sum("freq").alias("score"))
    return distinct.join(scored, "context", "left").select("context", F.coalesce("score", F.lit(0.0)).alias("score"))
