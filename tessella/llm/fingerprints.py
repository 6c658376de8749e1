"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Words are runs of anything but ASCII white space. The hashes of a text's
five-word shingles are sorted once; the top bits of a hash name its bin and the
first hash in a bin is the bin's minimum. An empty bin borrows from a non-empty
one: each empty bin tries the bins its own hashes name, the same for all texts,
until it meets a non-empty one (optimal densification; after eight tries the
non-empty bin with the least hash is taken). Only the low
eight bits of each bin are kept, packed to hex; the likeness of two
fingerprints takes the chance agreement of eight bits out.

Edge cases: a null text is the empty text; a text of fewer words than a shingle
has its whole sequence as one shingle; a text without words has the fixed
fingerprint ``EMPTY``, of likeness 1 to itself and 0 to others; equal texts have
equal fingerprints; a text of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS = 7  # 128 bins
LOW_BITS = 8
ATTEMPTS = 8
EMPTY = "0" * (2 << BIN_BITS)


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """xxhash64 of every k-word shingle (not deduplicated); empty for no words."""
    n = F.size(words)
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(many)


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the fingerprint of ``text`` as the hex column ``out``."""
    bins = 1 << BIN_BITS
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")
    low = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))), LOW_BITS // 4, "0")
    clean = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))
    firsts = F.filter("_sorted", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_sorted", i - 1))))
    # Minima and one blank for each bin, in bin order; a blank behind a minimum goes.
    blanks = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("b"), F.lit(1).alias("blank"), F.lit(None).cast("string").alias("v")))
    minima = F.transform("_firsts", lambda h: F.struct(bin_of(h).alias("b"), F.lit(0).alias("blank"), low(h).alias("v")))
    slots = F.transform(F.filter("_both", lambda x, i: (x["blank"] == 0) | (i == 0) | (F.get("_both", i - 1)["b"] != x["b"])), lambda x: x["v"])
    tried = lambda b, j: F.get("_slots", F.pmod(F.xxhash64(F.lit(j), b), F.lit(bins)).cast("int"))
    nearest = lambda b: F.array_min(F.transform("_firsts", lambda h: F.struct(F.xxhash64(F.lit(ATTEMPTS), b, bin_of(h)).alias("o"), low(h).alias("v"))))["v"]
    dense = F.transform("_slots", lambda v, b: F.coalesce(v, *[tried(b, j) for j in range(ATTEMPTS)], nearest(b)))
    return (
        df.withColumn("_words", words)
        .withColumn("_sorted", F.sort_array(shingle_hashes(F.col("_words"))))
        .withColumn("_firsts", firsts)
        .withColumn("_both", F.sort_array(F.concat(minima, blanks)))
        .withColumn("_slots", slots)
        .withColumn(out, F.when(F.size("_firsts") == 0, F.lit(EMPTY)).otherwise(F.array_join(dense, "")))
        .drop("_words", "_sorted", "_firsts", "_both", "_slots")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    bins, step = 1 << BIN_BITS, LOW_BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(bins * step), F.lit(step)), F.lit(0),
        lambda n, i: n + (F.substr(a, i, F.lit(step)) == F.substr(b, i, F.lit(step))).cast("int"),
    )
    chance = 1.0 / (1 << LOW_BITS)
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == EMPTY) | (b == EMPTY), 0.0).otherwise(corrected)


def with_next(df: DataFrame, id_col: str, columns: dict[str, str], rows_per_range: int = 2000, derive=None) -> DataFrame:
    """Add for each (from, to) of ``columns`` the value of the next row in descending id order; the first follows the last.

    Rows are dealt into ranges of the id; each range is closed by a copy of the
    first row of the range below it. Null ids come last; rows with one id are
    ordered by their values. ``derive`` adds columns to the rows, the closing
    copies included, once they are dealt; ``columns`` may name those too.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    df = df.withColumn("_key", key)
    derive = derive or (lambda x: x)
    given = [c for c in columns if c in df.columns]
    n = df.count()
    if n == 0:
        return derive(df).select("*", *[F.col(a).alias(b) for a, b in columns.items()]).drop("_key")
    # A range is one reducer's work, so there are never more ranges than a large job has tasks.
    ranges = max(1, min(20_000, n // rows_per_range))
    bounds = sorted(set(df.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)] or [0.5], 100_000).alias("b")).first()["b"]))
    # Number of bounds at or below the key, by halving steps over the sorted array.
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    arr = F.array(*[F.lit(int(b)) for b in bounds])
    placed = df.withColumn("_bounds", arr)
    count = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda p, s: F.when((p + s <= len(bounds)) & (F.get("_bounds", p + s - 1) <= F.col("_key")), p + s).otherwise(p),
    )
    placed = placed.withColumn("_range", count).drop("_bounds")
    tops = placed.groupBy("_range").agg(F.max("_key").alias("_top"))
    # One id per range: bounded by the number of ranges.
    tops = {r["_range"]: r["_top"] for r in tops.collect()}
    present = sorted(tops)
    follow = {tops[r]: present[(i + 1) % len(present)] for i, r in enumerate(present)}
    wanted = spark.createDataFrame([(k, r) for k, r in follow.items()], "_first long, _to int")
    heads = (
        placed.join(F.broadcast(wanted), F.col("_key") == F.col("_first"))
        .groupBy("_to").agg(F.max(F.struct(*given)).alias("_s"))
        .select(F.col("_to").alias("_range"), F.lit(1).alias("_tail"), *[F.col("_s").getField(c).alias(c) for c in given])
    )
    both = derive(placed.withColumn("_tail", F.lit(0)).unionByName(heads, allowMissingColumns=True))
    order = Window.partitionBy("_range").orderBy(F.col("_tail"), F.col("_key").desc(), *[F.col(c).desc() for c in given])
    return both.select("*", *[F.lead(a).over(order).alias(b) for a, b in columns.items()]).where("_tail = 0").drop("_key", "_range", "_tail")
