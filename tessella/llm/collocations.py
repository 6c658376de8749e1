"""Phrase collocation mining by best-first branch-and-bound growth.

A phrase of 2 to 4 words that occurs ``a`` times scores
``floor(2000000 a / (l + r))``, l and r being the counts of its parts at the cut
with the lowest score. A phrase is dropped if a longer frequent one around it
occurs at least 0.8 times as often; as counts only fall with length, it is enough
to look at phrases one word longer.

Growth: no phrase that begins with p scores more than
``floor(2000000 f(p) / (f(first word of p) + f(p)))``, because its count is at
most f(p) and what follows the first word occurs at least that often. Every
language has a threshold, at first that of its best pairs. All prefixes whose
bound reaches it are grown, and the neighbours of all phrases that reach it are
counted on both sides. When a language has its full number of survivors at or
above the threshold, these, ties included, are settled; else the threshold goes
down and the frontier is grown further, in the end over everything.

Counting is a pass over the texts: words are coded within a block, phrases
counted there, and counts summed by (language, phrase). Which phrases a pass
looks for is told to the tasks by bit fields of a fixed size (``FILTER_BITS``);
a bit that two phrases share lets a phrase be counted in vain, no more, as every
use of a count is a join on the phrase itself. Counts are whole numbers and
scores decimals, so nothing is rounded.

Edge cases: a null language is ``und``; a null or empty text has no words; rows
that repeat count again; equal scores rank by count, then by the phrase's bytes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.words import mix, text_chunks, word_hashes

FILTER_BITS = 25
BLOCK_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BORDER = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_APART = _BORDER | np.isin(np.arange(256), [32, 9])
_COEFFS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


# --- bit fields ---------------------------------------------------------------


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words, one array for each place."""
    if len(words) == 1:
        return words[0]
    out = np.zeros(len(words[0]), np.uint64)
    for h, c in zip(words, _COEFFS):
        out += h * c
    return mix(out)


def holds(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_field(phrases: DataFrame, n: int) -> np.ndarray:
    """The bits of all (lang, phrase) rows of ``n`` words: 2**FILTER_BITS at most, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            codes = np.asarray(langs.indices)
            salt = np.array([lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
            for lo, hi, data, offs in text_chunks(b.column(1)):
                h = word_hashes(data, offs, False)[0].reshape(hi - lo, n)
                h = mix(h ^ salt[codes[lo:hi]][:, None])
                at = np.unique(phrase_hash([h[:, k] for k in range(n)]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], ["slot", "bits"])

    slots = phrases.select("lang", "phrase").mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    field = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    field[slots["slot"].to_numpy()] = slots["bits"].to_numpy().astype(np.uint32)
    return field.view(np.uint8)


# --- counting passes ----------------------------------------------------------


class Block:
    """The words of a block of texts as numbers by (language, word), with the phrases that the bit fields let through."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: np.ndarray, names: list[str]) -> None:
        data = _LOWER[data]
        word = ~_APART[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offs[(offs > 0) & (offs < len(data))]
        begin[inner] = word[inner]
        starts = np.flatnonzero(begin)
        self.size = len(starts)
        if not self.size:
            return
        doc = np.searchsorted(offs, starts, side="right") - 1
        piece = np.cumsum(_BORDER[data])[starts] + doc  # both grow, so equal sums are equal pieces
        self.joined = piece[1:] == piece[:-1]
        edges = np.append(np.cumsum(word)[starts] - 1, word.sum()).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(edges), pa.py_buffer(data[word])]).dictionary_encode()
        self.words, self.names = coded.dictionary, names
        self.of, own = pd.factorize(langs[doc].astype(np.int64) * len(coded.dictionary) + np.asarray(coded.indices))
        self.lang, self.word = own // len(coded.dictionary), own % len(coded.dictionary)
        packed = coded.dictionary.cast(pa.large_binary())
        buffers = packed.buffers()
        bounds = np.frombuffer(buffers[1], np.int64, len(packed) + 1, packed.offset * 8)
        plain = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]]
        h = word_hashes(plain, bounds - bounds[0], False)[0]
        salt = np.array([lang_hash(x) for x in names], np.uint64)
        self.hash = mix(h[self.word] ^ salt[self.lang])

    def grams(self, at: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of ``n`` words at places ``at``, numbered, with their words and hash; ``before`` numbers the phrases of n-1 words."""
        codes, _ = pd.factorize(before[at].astype(np.int64) * len(self.word) + self.of[at + n - 1])
        example = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        example[codes] = at
        parts = np.stack([self.of[example + k] for k in range(n)]) if len(example) else np.zeros((n, 0), np.int64)
        return codes, parts, phrase_hash([self.hash[p] for p in parts]) if n < 4 else np.zeros(0, np.uint64)

    def counted(self, codes: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        lang = pa.array(self.names, pa.string()).take(pa.array(self.lang[parts[0]]))
        words = [self.words.take(pa.array(self.word[p])) for p in parts]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", words[0].type)) if len(words) > 1 else words[0]
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(codes, minlength=parts.shape[1]).astype(np.int64))], ["lang", "phrase", "f"])

    def count(self, n: int, fields: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        """Counts of phrases of ``n`` words that the bit fields ask for."""
        if not self.size:
            return None
        if n == 1:
            return self.counted(self.of, np.arange(len(self.word))[None, :])
        frequent = holds(fields["words"], self.hash)
        at = np.flatnonzero(self.joined & frequent[self.of[:-1]] & frequent[self.of[1:]])
        codes, parts, h = self.grams(at, self.of, 2)
        if n == 2:
            return self.counted(codes, parts)
        pairs = self._numbered(at, codes, holds(fields["pairs"], h))
        at = np.flatnonzero((pairs[:-1] >= 0) & (pairs[1:] >= 0))
        if n == 3 and "grow2" in fields:
            at = at[holds(fields["grow2"], h)[pairs[at]] | holds(fields["near2"], h)[pairs[at + 1]]]
        codes, parts, h = self.grams(at, pairs, 3)
        if n == 3:
            if "wanted" in fields:
                pick = holds(fields["wanted"], h)
                codes, parts = codes[pick[codes]], parts[:, pick]
                codes = (np.cumsum(pick) - 1)[codes] if len(codes) else codes
            return self.counted(codes, parts)
        triples = self._numbered(at, codes, np.ones(len(h), bool))
        at = np.flatnonzero((triples[:-1] >= 0) & (triples[1:] >= 0))
        at = at[holds(fields["grow3"], h)[triples[at]] | holds(fields["near3"], h)[triples[at + 1]]]
        return self.counted(*self.grams(at, triples, 4)[:2])

    def _numbered(self, at: np.ndarray, codes: np.ndarray, kept: np.ndarray) -> np.ndarray:
        out = np.full(self.size, -1, np.int64)
        pick = kept[codes] if len(codes) else np.zeros(0, bool)
        out[at[pick]] = codes[pick]
        return out


def counts(texts: DataFrame, n: int, least: int, fields: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(lang, phrase, f) of all phrases of ``n`` words that ``fields`` ask for and that occur ``least`` times."""
    sent = texts.sparkSession.sparkContext.broadcast(fields or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(0).dictionary_encode()
            langs, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            for lo, hi, data, offs in text_chunks(b.column(1), BLOCK_BYTES):
                out = Block(data, offs, langs[lo:hi], names).count(n, sent.value)
                if out is not None and out.num_rows:
                    yield out

    summed = texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(summed.where(F.col("f") >= least), f"grams{n}")


# --- scores and survival ------------------------------------------------------


def _floor_score(a: str, parts: str) -> Column:
    return F.expr(f"(cast({a} as decimal(20,0)) * cast(2000000 as decimal(7,0))) div ({parts})")


def _part(phrase: str, lo: int, hi: int) -> Column:
    """Words lo to hi (from 1) of a phrase."""
    return F.substring_index(F.substring_index(phrase, " ", hi), " ", lo - hi - 1)


def _with_count(df: DataFrame, part: Column, table: DataFrame, name: str, how: str = "inner") -> DataFrame:
    other = table.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    return df.withColumn("_k", part).join(other, (F.col("lang") == F.col("_l")) & (F.col("_k") == F.col("_p")), how).drop("_l", "_p", "_k")


def scored(grams: DataFrame, n: int, tables: dict[int, DataFrame]) -> DataFrame:
    """``grams`` with l, r and score of their lowest cut, and the bound of all that begins with them."""
    cuts = []
    for k in range(1, n):
        grams = _with_count(grams, _part("phrase", 1, k), tables[k], f"_l{k}")
        grams = _with_count(grams, _part("phrase", k + 1, n), tables[n - k], f"_r{k}")
        sums = f"cast(_l{k} as decimal(20,0)) + cast(_r{k} as decimal(20,0))"
        cuts.append(F.struct(_floor_score("f", sums).alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    bound = _floor_score("f", "cast(_l1 as decimal(20,0)) + cast(f as decimal(20,0))")
    return grams.withColumn("_b", best).select("lang", "phrase", "f", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").alias("score"), bound.alias("bound"))


def survivors(phrases: DataFrame, n: int, longer: DataFrame) -> DataFrame:
    """Phrases of ``n`` words that no phrase of n+1 words around them matches in 0.8 of their places."""
    inside = F.explode(F.array_distinct(F.array(_part("phrase", 1, n), _part("phrase", 2, n + 1))))
    most = longer.select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return _with_count(phrases, F.col("phrase"), most, "_most", "left").where("_most is null or 5 * _most < 4 * f").drop("_most")


def _at_rank(df: DataFrame, rank: int) -> DataFrame:
    """(lang, score) of the row at ``rank`` by score, ties included, of each language that has as many."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rank).groupBy("lang").agg(F.min("score").alias("score"), F.max("_n").alias("_n")).where(F.col("_n") == rank).drop("_n")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, widen: int = 4) -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score).

    The first threshold is the score of the pair at rank ``widen * top``; every
    further round takes a rank ``widen`` squared times as low, 4 times at least.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = counts(texts, 1, 1)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    fields = {"words": bit_field(words, 1)}
    tables = {1: words, 2: counts(texts, 2, least, fields)}
    pairs = written(scored(tables[2], 2, tables), "pairs")
    fields["pairs"] = bit_field(pairs, 2)
    open_langs = written(pairs.select("lang").distinct(), "open")
    rank, settled = widen * top, None
    while True:
        # languages without a pair at this rank are grown over everything
        limits = written(open_langs.join(_at_rank(pairs, rank).withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l"), "left").select(F.col("lang").alias("_lang"), F.coalesce("score", F.lit(0).cast("long")).alias("_limit")), "limits")
        held = lambda df: df.join(limits, F.col("lang") == F.col("_lang"))
        grow = held(pairs).where("bound >= _limit")
        near = held(pairs).where("score >= _limit")
        now = dict(tables)
        now[3] = counts(texts, 3, least, {**fields, "grow2": bit_field(grow, 2), "near2": bit_field(near, 2)})
        triples = written(held(scored(now[3], 3, now)), "triples")
        near3 = triples.where("score >= _limit")
        now[4] = counts(texts, 4, least, {**fields, "grow3": bit_field(triples.where("bound >= _limit"), 3), "near3": bit_field(near3, 3)})
        # the rest of a phrase may be a triple that was not grown; only those that can matter are counted
        ends = now[4].select("lang", _part("phrase", 2, 4).alias("phrase")).distinct()
        missing = written(ends.join(now[3].select(F.col("lang").alias("_l"), F.col("phrase").alias("_p")), (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left_anti"), "missing")
        if missing.take(1):
            more = counts(texts, 3, least, {**fields, "wanted": bit_field(missing, 3)})
            fresh = more.join(now[3].select(F.col("lang").alias("_l"), F.col("phrase").alias("_p")), (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left_anti")
            now[3] = written(now[3].unionByName(fresh), "grams3")
        four = held(scored(now[4], 4, now)).where("score >= _limit")
        alive = survivors(near, 2, now[3]).unionByName(survivors(near3, 3, now[4])).unionByName(four)
        alive = written(alive.select("lang", "phrase", "f", "l", "r", "score", "_limit"), "alive")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
        ranked = alive.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        full = written(limits.join(ranked.groupBy("lang").count(), F.col("_lang") == F.col("lang"), "left").select(F.col("_lang").alias("_full"), (F.coalesce("count", F.lit(0)) >= top).alias("_enough"), (F.col("_limit") == 0).alias("_all")), "full")
        done = ranked.join(full.where("_enough or _all"), F.col("lang") == F.col("_full")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "score")
        settled = done if settled is None else settled.unionByName(done)
        open_langs = full.where("not _enough and not _all").select(F.col("_full").alias("lang"))
        if not open_langs.take(1):
            break
        rank *= max(4, widen * widen)
    totals = totals.withColumnRenamed("lang", "_l")
    return settled.join(totals, F.col("lang") == F.col("_l")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
