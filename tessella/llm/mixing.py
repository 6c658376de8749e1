"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: the number of times its documents must be repeated on
average so that its share of all characters reaches its target weight. Every
document draws a count from the Poisson distribution with that rate by
inverting its distribution function at a number made from a keyed hash of the
document, is repeated that often, and the copies are dealt out and ordered by
another hash.

Edge cases: a null source is a source of its own; a null text has no characters
but is drawn like others; sources without a target weight (or a weight of 0)
get rate 0; a target without documents is ignored and the remaining weights are
scaled up; rows that repeat a document id and text draw the same count; an
empty table gives no rows; other columns pass through untouched, whatever their
names, unless these are ``copy``, ``rate`` or ``shuffle_key``, which the added
columns replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _log_factorial(n: Column) -> Column:
    """log(n!): a sum of logs, from 256 on Stirling's series (its error is below 1e-15 there)."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.greatest(n, F.lit(1)), F.lit(256))), F.lit(0.0), lambda a, x: a + F.log(x.cast("double")))
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 256, few).otherwise(series)


def poisson_table(rates: DataFrame) -> DataFrame:
    """Add ``least`` and ``cdf``: P(X <= k) for k = least, least + 1, ... up to 1.

    The entries reach from 12 standard deviations below the mean to 12 and 30
    above it, beyond what any 48-bit number can tell from 0 and 1. One pass
    carries the log of the term and the running sum.
    """
    rate, spread = F.col("rate"), 12 * F.sqrt("rate")
    least = F.greatest(F.lit(0).cast("long"), F.floor(rate - spread).cast("long"))
    steps = F.sequence(F.col("least") + 1, F.ceil(rate + spread + 30).cast("long"))
    log_first = F.col("least") * F.log(rate) - rate - _log_factorial(F.col("least"))
    first = F.struct(log_first.alias("log"), F.exp(log_first).alias("sum"), F.array(F.exp(log_first)).alias("all"))

    def further(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(a["all"], F.array(total)).alias("all"))

    # scaled, as the logs of a large rate carry an error of some 1e-10
    sums = F.aggregate(steps, first, further, lambda a: F.transform(a["all"], lambda x: x / a["sum"]))
    some = rates.withColumn("least", least)
    return some.withColumn("cdf", F.when(rate > 0, sums))


def source_rates(docs: DataFrame, targets: DataFrame | None, *, source_col: str, text_col: str, size_factor: float) -> DataFrame:
    """(source, chars, rate). ``targets`` has (source, weight); without it all sources weigh the same."""
    sizes = docs.groupBy(F.col(source_col).alias("_src")).agg(F.sum(F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")).alias("_chars"))
    sizes = written(sizes, "sizes")
    if targets is None:
        weighed = sizes.withColumn("_w", F.lit(1.0))
    else:
        t = targets.groupBy(F.col("source").alias("_ts")).agg(F.sum(F.coalesce(F.col("weight"), F.lit(0.0)).cast("double")).alias("_tw"))
        weighed = sizes.join(t, F.col("_src").eqNullSafe(F.col("_ts")), "left").select("_src", "_chars", F.coalesce("_tw", F.lit(0.0)).alias("_w"))
    sums = weighed.agg(F.sum("_chars").alias("c"), F.sum(F.when(F.col("_chars") > 0, F.col("_w"))).alias("w"))
    total = sums.select(F.struct("c", "w").alias("s")).scalar()
    weighed = weighed.withColumn("_t", total)
    share = F.col("_w") / F.col("_t.w")
    rate = F.when((F.col("_w") > 0) & (F.col("_chars") > 0), F.lit(float(size_factor)) * share * F.col("_t.c") / F.col("_chars")).otherwise(0.0)
    return weighed.select("_src", "_chars", rate.alias("rate"))


def mix_sources(
    docs: DataFrame, targets: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", size_factor: float = 1.0, seed: str = "mix",
) -> DataFrame:
    """``docs`` repeated by drawn counts, with ``copy`` (1, 2, ...), ``rate`` and ``shuffle_key``, globally shuffled.

    ``size_factor`` scales the expected number of characters against the input.
    """
    own = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    spare = "_"  # with this in front no added column meets one of the caller's
    while any(c.startswith(spare) for c in own):
        spare += "_"
    rates = written(poisson_table(source_rates(docs, targets, source_col=source_col, text_col=text_col, size_factor=size_factor)), "rates")
    rates = rates.select(*[F.col(c).alias(spare + n) for c, n in (("_src", "source"), ("rate", "rate"), ("least", "least"), ("cdf", "cdf"))])
    ident = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    cdf, count, unit = F.col(spare + "cdf"), F.col(spare + "count"), F.col(spare + "unit")
    columns = [F.col(f"`{c}`") for c in own]
    drawn = (
        docs.select(*columns)
        .join(rates, F.col(source_col).eqNullSafe(F.col(spare + "source")), "left")
        .withColumn(spare + "unit", unit_hash(F.lit(seed), ident))
        .withColumn(spare + "count", F.col(spare + "least") + F.coalesce(F.size(F.filter(cdf, lambda x: x <= unit)), F.lit(0)))
        .where(cdf.isNotNull() & (count > 0))
    )
    copies = drawn.select(*columns, F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("copy"), F.col(spare + "rate").alias("rate"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string")).cast("binary")))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
