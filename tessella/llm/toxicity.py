"""Toxicity by the nearest labelled examples under exact TF-IDF cosine over block-max lists.

A bounded, hash-chosen sample of labelled rows is the example set. Words are
lower-cased runs of letters and non-ASCII characters; terms are words and the
openings of longer ones. The dimensions of the vector space are the ``max_terms``
terms of the examples that go most with one label (by the z of the two-by-two table), weighted by ``(1 + ln tf) * idf``.

The index has a list for every term: the examples that hold it with their
weights, cut into blocks of neighbouring examples, and the largest weight of
every block. Examples are ordered by their heaviest term, so that like ones
share blocks. A query sums the largest weights to a bound for every block,
visits blocks from the best bound on, and stops when no bound reaches its k-th
similarity: the neighbours are those of a full search. They vote with the inverse
square of their distance, so an equal text outvotes distant ones; a logistic
curve, fitted on the examples with themselves left out, makes a score of the
vote. Texts without any term get the share of toxic ones among such examples.

Words, their counts and the left-out votes are Spark jobs over the examples; the
driver receives ``max_terms`` words and at most ``max_examples`` rows of numbers.

Edge cases: null and empty texts have no terms; labels that are null, of unknown
documents or of null ids teach nothing; several labels of a document count as
toxic if one does; without any example every score is 0, with examples of one
label only it is the smoothed share; equal similarities rank by example id;
repeated rows are scored each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.words import text_chunks

#: Bounds of what is fitted: labelled rows looked at, and dimensions of the space.
EXAMPLES, TERMS = 12_000, 128
BLOCK = 32
#: Blocks visited between two looks at the k-th similarity.
STRIDE = 8
#: Lengths of the openings that stand beside a longer word, so that unseen endings count.
OPENINGS = (4, 5, 6)
NEIGHBOURS = 15
#: Distance that counts as none, and the weight of the even vote that every text starts with.
NEAR, EVEN = 0.02, 1.0
REMEMBERED = 200_000

_APART = np.ones(256, bool)
_APART[97:123] = _APART[128:] = False


# --- words --------------------------------------------------------------------


def coded_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(from row, to row, row of every word, code of every word, words by code) of slices of a text column."""
    lower = pc.utf8_lower(column.cast(pa.large_string()))
    for lo, hi, data, offs in text_chunks(lower):
        word = ~_APART[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offs[(offs > 0) & (offs < len(data))]
        begin[inner] = word[inner]
        starts = np.flatnonzero(begin)
        edges = np.append(np.cumsum(word)[starts] - 1, word.sum()).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[word])]).dictionary_encode()
        yield lo, hi, np.searchsorted(offs, starts, side="right") - 1, np.asarray(coded.indices), coded.dictionary


def variants(words: pa.Array) -> list[pa.Array]:
    """The words themselves, and for each length of ``OPENINGS`` those of longer words (else null), marked by a star."""
    plain = words.cast(pa.large_string())
    size = pc.utf8_length(plain)
    out = [plain]
    for n in OPENINGS:
        opening = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, n), pa.scalar("*", plain.type), pa.scalar("", plain.type))
        out.append(pc.if_else(pc.greater(size, n), opening, pa.scalar(None, plain.type)))
    return out


def term_counts(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's entries begin, terms in order, how often) over ``terms`` alone."""
    known = terms.cast(pa.large_binary()).cast(pa.large_string())
    first, found, often = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi, row, code, words in coded_words(column):
        keys = []
        for kind in variants(words):
            at = pc.index_in(kind, value_set=known, skip_nulls=True).fill_null(-1).to_numpy()[code]
            keys.append(row[at >= 0] * (len(terms) + 1) + at[at >= 0])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        found.append(key % (len(terms) + 1))
        often.append(n)
        first.append(first[-1][-1] + np.searchsorted(key // (len(terms) + 1), np.arange(1, hi - lo + 1)))
    return np.concatenate([first[0], *first[1:]]), np.concatenate(found), np.concatenate(often)


# --- index --------------------------------------------------------------------


@dataclass
class Index:
    """Block-max lists of the examples and the calibration of their votes."""

    terms: list[bytes]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    top: np.ndarray  # terms x blocks: largest weight
    at: np.ndarray  # terms x (blocks + 1): where a block's entries begin
    holder: np.ndarray  # entries by term: example
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    blank: float = 0.0

    def weighted(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, similarities, entries read) of the k most similar ones, best first, then by id; ``skip`` is left out."""
        bounds = w @ self.top[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.searchsorted(-bounds[order], 0.0)]  # blocks that share a term
        best, near, read, edge = np.zeros(0), np.zeros(0, np.int64), 0, 0.0
        for a in range(0, len(order), STRIDE):
            # sums of rounded products may differ in the last digits
            blocks = order[a : a + STRIDE]
            if len(best) >= k and bounds[blocks[0]] < edge - 1e-9:
                break
            begin, size = self.at[terms][:, blocks], self.at[terms][:, blocks + 1] - self.at[terms][:, blocks]
            ends = np.cumsum(size)
            places = np.arange(ends[-1]) + np.repeat(begin.ravel() - ends + size.ravel(), size.ravel())
            read += len(places)
            slot = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), size.ravel()) * BLOCK + self.holder[places] % BLOCK
            s = np.bincount(slot, self.weight[places] * np.repeat(w, size.sum(axis=1)), len(blocks) * BLOCK)
            hit = np.flatnonzero(s)
            own = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
            keep = own != skip
            best, near = np.append(best, s[hit[keep]]), np.append(near, own[keep])
            if len(best) > k:
                rank = np.lexsort((self.ids[near], -best))[:k]
                best, near = best[rank], near[rank]
                edge = best[-1]
        rank = np.lexsort((self.ids[near], -best))[:k]
        return near[rank], np.minimum(best[rank], 1.0), read

    def vote(self, near: np.ndarray, s: np.ndarray) -> float:
        """Share of toxic neighbours, weighed by inverse squared distance, as log-odds."""
        w = (1 - s + NEAR) ** -2
        toxic = float((w * self.labels[near]).sum())
        return float(np.log((toxic + EVEN) / (float(w.sum()) - toxic + EVEN)))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -700, 700))))


def build_index(terms: list[bytes], ids: np.ndarray, labels: np.ndarray, first: np.ndarray, found: np.ndarray, tf: np.ndarray) -> Index:
    """Lists of examples given as term counts; the entries of example ``e`` begin at ``first[e]``. Not calibrated."""
    n, df = len(ids), np.bincount(found, minlength=len(terms))
    idf = np.log((1 + n) / (1 + df)) + 1
    own = np.repeat(np.arange(n), np.diff(first))
    w = (1 + np.log(tf)) * idf[found]
    norm = np.sqrt(np.bincount(own, w * w, n)) if n else np.zeros(0)
    w = w / norm[own]
    heaviest, strongest = np.full(n, len(terms)), np.zeros(n)
    np.maximum.at(strongest, own, w)
    lead = w == strongest[own]
    np.minimum.at(heaviest, own[lead], found[lead])
    order = np.lexsort((ids, -strongest, heaviest))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    holder = place[own]
    by_term = np.lexsort((holder, found))
    found, holder, w = found[by_term], holder[by_term], w[by_term]
    blocks = -(-n // BLOCK)
    key = found * max(blocks, 1) + holder // BLOCK
    at = np.searchsorted(key, np.arange(len(terms) * blocks + 1))
    top = np.zeros(len(terms) * blocks)
    np.maximum.at(top, key, w)
    edges = np.concatenate([at[:-1].reshape(len(terms), blocks), at[1:].reshape(len(terms), blocks)[:, -1:]], axis=1) if blocks else np.zeros((len(terms), 1), np.int64)
    return Index(terms, idf, ids[order], labels[order], top.reshape(len(terms), blocks), edges, holder, w)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with a weak pull to slope 1 and shift 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) if len(x) else x
        g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


# --- learning -----------------------------------------------------------------


def _words_of(examples: DataFrame) -> DataFrame:
    """(word, df, toxic): in how many examples, and toxic ones, a word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, row, code, words in coded_words(b.column(0)):
                for kind in variants(words):
                    terms = kind.dictionary_encode()
                    at = terms.indices.fill_null(-1).to_numpy()[code].astype(np.int64)
                    key = np.unique(at[at >= 0] * (hi - lo) + row[at >= 0])
                    which, of = key // (hi - lo), key % (hi - lo)
                    df = np.bincount(which, minlength=len(terms.dictionary))
                    toxic = np.bincount(which, label[lo + of], len(terms.dictionary))
                    yield pa.RecordBatch.from_arrays([terms.dictionary.cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(toxic.astype(np.int64))], ["word", "df", "toxic"])

    return examples.select("_t", "_y").mapInArrow(run, "word string, df long, toxic long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))


def _chosen_terms(examples: DataFrame, max_terms: int) -> list[bytes]:
    """The words with the largest |z| between occurrence and label, ties by word."""
    n, toxic = examples.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if n == 0 or toxic in (0, n):
        return []
    spread = F.sqrt(F.col("df") * (n - F.col("df")) * F.lit(float(toxic)) * (n - toxic) / n)
    z = F.when(F.col("df") < n, F.abs(n * F.col("toxic") - F.col("df") * toxic) / spread).otherwise(0.0)
    rows = _words_of(examples).withColumn("z", z).orderBy(F.desc("z"), "word").limit(max_terms).select("word").collect()
    return sorted(r["word"].encode() for r in rows)


def _counted(examples: DataFrame, terms: list[bytes]) -> pd.DataFrame:
    """Every example's terms and counts: at most ``max_examples`` rows of ``max_terms`` pairs of numbers."""
    value_set = pa.array(terms, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, found, often = term_counts(b.column(2), value_set)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["_id", "_y", "found", "often"])

    return examples.select("_id", "_y", "_t").mapInArrow(run, "_id long, _y int, found array<int>, often array<int>").toPandas().sort_values("_id")


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", max_examples: int = EXAMPLES, max_terms: int = TERMS) -> Index:
    """Fit the index on at most ``max_examples`` labelled rows, those with the least hash of their id."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("_lid")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_lid"), "_lid").limit(max_examples)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    # At most max_examples rows of two numbers are sent to the tasks.
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_t").alias("_t"))
    examples = written(joined, "examples")
    terms = _chosen_terms(examples, max_terms)
    rows = _counted(examples, terms)
    sizes = np.array([len(x) for x in rows["found"]], np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *rows[c]]).astype(np.int64) for c in ("found", "often")]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids, marks = rows["_id"].to_numpy(np.int64), rows["_y"].to_numpy(float)
    index = build_index(terms, ids, marks, first, *flat)
    handle = spark.sparkContext.broadcast(index)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = handle.value
        place = {int(i): k for k, i in enumerate(own.ids)}
        for b in batches:
            votes = []
            for i, found, often in zip(b["_id"], b["found"], b["often"]):
                t = np.asarray(found, np.int64)
                near, s, _ = own.nearest(t, own.weighted(t, np.asarray(often)), skip=place[i]) if len(t) else (t, t, 0)
                votes.append(own.vote(near, s) if len(near) else None)
            yield pd.DataFrame({"y": b["_y"], "vote": pd.Series(votes, dtype=float)})

    table = spark.createDataFrame(rows, "_id long, _y int, found array<int>, often array<int>")
    voted = table.repartition(spark.sparkContext.defaultParallelism).mapInPandas(leave_out, "y int, vote double").toPandas()
    y, vote = voted["y"].to_numpy(float), voted["vote"].to_numpy(float)
    has = ~np.isnan(vote)
    prior = (marks.sum() + 0.1) / (len(marks) + 1) if len(marks) else 0.0
    index.blank = float((y[~has].sum() + prior) / ((~has).sum() + 1))
    index.slope, index.shift = _logistic(vote[has], y[has])
    return index


# --- scoring ------------------------------------------------------------------


class _Scorer:
    """Scores texts in a task; equal term counts are looked up once."""

    def __init__(self, index: Index):
        self.index, self.terms, self.known = index, pa.array(index.terms, pa.binary()), {}

    def __call__(self, column: pa.Array) -> list[tuple[float, list[int], list[float]]]:
        first, found, often = term_counts(column, self.terms)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            t, n = found[a:b], often[a:b]
            key = t.astype(np.int32).tobytes() + n.astype(np.int32).tobytes()
            if key not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = self.scored(t, n)
            out.append(self.known[key])
        return out

    def scored(self, t: np.ndarray, n: np.ndarray) -> tuple[float, list[int], list[float]]:
        near, s, _ = self.index.nearest(t, self.index.weighted(t, n)) if len(t) else (t, t, 0)
        if not len(near):
            return self.index.blank, [], []
        return self.index.score(self.index.vote(near, s)), self.index.ids[near].tolist(), s.tolist()


def score_texts(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``, ``predicted``, ``neighbours``, ``similarities``) of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(handle.value)
        for b in batches:
            out = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                ["k", "score", "neighbours", "similarities"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"k {kind}, score double, neighbours array<long>, similarities array<double>")
    return scored.select(F.col("k").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities")


def toxicity(docs: DataFrame, index: Index, text_col: str = "text") -> Column:
    """The score of ``text_col`` as a column of ``docs``."""
    handle = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(handle.value)
        for batch in batches:
            yield pd.Series([x[0] for x in scorer(pa.array(batch, pa.large_string(), from_pandas=True))], dtype=float)

    return F.pandas_udf(run, "double")(F.col(text_col))
