"""Language-model scores by a class bigram model with exchange-clustered classes.

A text is its words (A-Z lower-cased, runs of anything but ASCII white space)
and one end token. The probability of a token is that of its class after the
class before it, times that of the word in its class; both are smoothed by
added counts. Words are 64-bit hashes.

Words with a share of at least ``UNIT_SHARE`` of the training tokens are
clustered one by one; all rarer words are clustered with those of the same
ending (``ENDINGS`` buckets). So there are at most ``1 / UNIT_SHARE + ENDINGS``
units to cluster, whatever the size of the corpus, and every word has a class,
unseen ones too. In each exchange round a unit moves to the class that raises
the class-bigram likelihood most; units are judged side by side against the
counts of the round's start, a third of them at a time, and the best assignment
met is kept.

Counts cover all training texts. Words with a share of at least ``LOCAL_SHARE``
(at most ``1 / LOCAL_SHARE`` of them) are counted from a table that every task
holds; the rest, none of which can be a frequent key, are joined.

Edge cases: null and empty texts are one end token; rows that share an id are
told apart by their text; repeated rows are scored each and count each; null ids
take part; without training texts all counts are 0 and scores come from the
smoothing alone; an empty table gives no rows; other columns are not read; texts
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.repeats import identified
from tessella.llm.words import mix, text_chunks, word_hashes

CLASSES = 64
ENDINGS = 256
UNIT_SHARE = 1 / 20_000
LOCAL_SHARE = 1 / 1_000_000
ROUNDS = 9
SMOOTHING = 0.5
FLUSH_TOKENS = 4_000_000

END = np.array([0x656E64], np.uint64)
END_HASH = mix(END)[0]
END_BUCKET = ENDINGS  # the end token has a bucket of its own


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, first) of all tokens of a chunk, each text closed by its end token."""
    h, _, stops, first = word_hashes(data, offs, lower=True)
    bucket = np.zeros(len(h), np.int64)
    if len(h):
        starts = stops - 1
        last = data[starts].astype(np.uint64)
        before = np.where(starts > 0, data[np.maximum(starts - 1, 0)], 0).astype(np.uint64)
        bucket = (mix(last * np.uint64(256) + before) % np.uint64(ENDINGS)).astype(np.int64)
    n = np.diff(first)
    new_first = np.concatenate([[0], np.cumsum(n + 1)])
    out, kind = np.full(new_first[-1], END_HASH, np.uint64), np.full(new_first[-1], END_BUCKET, np.int64)
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out[place], kind[place] = h, bucket
    return out, kind, new_first


def _summed(rows: DataFrame, emit, schema: str) -> DataFrame:
    """Rows (code, tag, n) of arrays made by ``emit`` per chunk, added up over a task's chunks before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            codes, tags = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            u, at, n = np.unique(codes, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(tags[at].astype(np.int32)), pa.array(n)], ["code", "tag", "n"])

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                held.append(emit(*_tokens(data, offs)))
                size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("_text").mapInArrow(run, schema)


@dataclass
class Lookup:
    """Sorted hashes with a value each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, h: np.ndarray, default: int) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(h), default, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], default)


@dataclass
class ClassModel:
    units: Lookup  # frequent words; the rest have unit len(units) + bucket
    classes: np.ndarray  # class of each unit
    local: Lookup  # counts of the words every task knows
    log_move: np.ndarray  # (CLASSES + 1) x CLASSES, the last row is the start
    log_size: np.ndarray  # log10 of the emission denominator of each class
    n: int
    v: int

    def unit_of(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return unit_of(self.units, h, bucket)


def unit_of(units: Lookup, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    u = units.get(h, -1)
    return np.where(u >= 0, u, len(units.keys) + bucket)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(c: np.ndarray, rows: np.ndarray, cols: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_n: float) -> int:
    """Class to which moving one unit raises the likelihood most.

    ``c`` has the class-bigram counts with the start as its last row; ``right``
    and ``left`` the unit's counts by following and preceding class, itself left out.
    """
    k = CLASSES
    c, rows, cols = c.copy(), rows.copy(), cols.copy()
    c[own, :] -= right
    c[:, own] -= left
    c[own, own] -= self_n
    out, into = right.sum() + self_n, left.sum() + self_n
    rows[own] -= out
    cols[own] -= into
    gain = (_f(c[:k] + right) - _f(c[:k])).sum(axis=1) + (_f(c + left[:, None]) - _f(c)).sum(axis=0)
    d = np.arange(k)
    cc = c[d, d]
    gain += _f(cc + right + left[:k] + self_n) - _f(cc + right) - _f(cc + left[:k]) + _f(cc)
    gain -= _f(rows[:k] + out) - _f(rows[:k]) + _f(cols + into) - _f(cols)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 else own


def _likelihood(c: np.ndarray) -> float:
    return float(_f(c).sum() - _f(c.sum(axis=1)).sum() - _f(c.sum(axis=0)).sum())


def exchange(pairs: DataFrame, n_units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class-bigram counts with the start as last row) from rows (a, b, n) of unit bigrams; the start is unit ``n_units``."""
    sc = pairs.sparkSession.sparkContext
    # The neighbours of a unit are at most all units; they are gathered once.
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("o"), F.lit(0).alias("d"), "n").union(pairs.select("b", "a", F.lit(1), "n"))
    near = written(both.groupBy("u").agg(F.collect_list("o").alias("o"), F.collect_list("d").alias("d"), F.collect_list("n").alias("n")), "near")
    k = CLASSES

    def class_counts(handle):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, total = handle.value, np.zeros((k + 1) * k, np.int64)
            for b in batches:
                u = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
                o, d, n = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
                out = d == 0
                np.add.at(total, classes[u[out]] * k + classes[o[out]], n[out])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        cells = near.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        c = np.zeros((k + 1) * k)
        for r in cells:
            c[r["cell"]] = r["n"]
        return c.reshape(k + 1, k)

    def moves(handle, counts, turn):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, c = handle.value, counts.value
            rows, cols = c.sum(axis=1), c.sum(axis=0)
            for b in batches:
                units, to = [], []
                ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
                o, d, n = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
                for i, u in enumerate(b.column(0).to_numpy()):
                    if u == n_units or turn is not None and u % 3 != turn:
                        continue
                    x, y, z = o[ends[i] : ends[i + 1]], d[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
                    other = x != u
                    right = np.bincount(classes[x[(y == 0) & other]], z[(y == 0) & other], k + 1)[:k]
                    left = np.bincount(classes[x[(y == 1) & other]], z[(y == 1) & other], k + 1)
                    best = best_class(c, rows, cols, int(classes[u]), right, left, float(z[(y == 0) & ~other].sum()))
                    if best != classes[u]:
                        units.append(u)
                        to.append(best)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(to, pa.int64())], ["u", "c"])

        return near.mapInArrow(run, "u long, c long").collect()  # at most one row per unit

    classes = np.append(np.arange(n_units) % k, k)
    best, best_c, best_l, still = classes, None, -np.inf, 0
    for turn in range(rounds + 1):
        handle = sc.broadcast(classes)
        c = class_counts(handle)
        likelihood = _likelihood(c)
        if likelihood > best_l:
            best, best_c, best_l = classes, c, likelihood
        if turn == rounds or still == 3:
            break
        changed = moves(handle, sc.broadcast(c), turn % 3)
        still = 0 if changed else still + 1
        classes = classes.copy()
        for r in changed:
            classes[r["u"]] = r["c"]
    return best, best_c


def train(rows: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of the rows' ``_text``, and the counts (wh, c) of the words that it does not hold itself."""
    counts = _summed(rows, lambda h, b, first: (h, b), "code long, tag int, n long").groupBy("code").agg(F.min("tag").alias("tag"), F.sum("n").alias("n"))
    counts = written(counts, "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unit_floor, local_floor = max(1, int(np.ceil(n * UNIT_SHARE))), max(1, int(np.ceil(n * LOCAL_SHARE)))
    # Both collected tables are bounded by the inverse of a share.
    held = counts.where(F.col("n") >= local_floor).select("code", "n").toPandas()
    codes, sizes = held["code"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(np.int64)
    frequent = np.sort(codes[sizes >= unit_floor])
    units = Lookup(frequent, np.arange(len(frequent)))
    n_units = len(frequent) + ENDINGS + 1
    handle = rows.sparkSession.sparkContext.broadcast(units)

    def bigrams(h, bucket, first):
        u = unit_of(handle.value, h, bucket)
        before = np.empty_like(u)
        before[1:] = u[:-1]
        before[first[:-1]] = n_units
        return (before * (n_units + 1) + u).astype(np.uint64), np.zeros(len(u), np.int32)

    pairs = _summed(rows, bigrams, "code long, tag int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    width = n_units + 1
    pairs = pairs.select(F.floor(F.col("code") / width).alias("a"), F.pmod("code", F.lit(width)).alias("b"), "n")
    classes, c = exchange(pairs, n_units)

    # Tokens and known words of each class: frequent words one by one, the rest by ending.
    tokens, known = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens, classes[: len(frequent)], Lookup.of(codes, sizes).get(frequent, 0))
    np.add.at(known, classes[: len(frequent)], 1)
    for r in counts.where(F.col("n") < unit_floor).groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        at = classes[len(frequent) + r["tag"]]
        tokens[at] += r["n"]
        known[at] += r["v"]
    move = np.log10((c + SMOOTHING) / (c.sum(axis=1, keepdims=True) + SMOOTHING * CLASSES))
    model = ClassModel(units, classes, Lookup.of(codes, sizes), move, np.log10(tokens + known + 1), int(n), int(v))
    return model, counts.where(F.col("n") < local_floor).select(F.col("code").alias("wh"), F.col("n").alias("c"))


def score(docs: DataFrame, train_on: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of every row.

    ``train_on`` picks the rows of ``docs`` that the model learns from (all by
    default); ``base_score`` is the unigram score with one added count.
    """
    rows = identified(docs, id_col, text_col)
    model, rare = train(identified(docs if train_on is None else docs.where(train_on), id_col, text_col))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        for batch in batches:
            docs_, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offs in text_chunks(batch.column(2)):
                h, bucket, first = _tokens(data, offs)
                cls = m.classes[m.unit_of(h, bucket)]
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[first[:-1]] = CLASSES
                known = m.local.get(h, 0)
                fixed = np.add.reduceat(m.log_move[before, cls] - m.log_size[cls], first[:-1])
                logs = np.add.reduceat(np.log10(known + 1.0), first[:-1])
                text = np.repeat(np.arange(b - a), np.diff(first))
                # One row for the text itself (without a word), one for each of its words that is not held here.
                open_ = known == 0
                code, tf_at = np.unique(np.rec.fromarrays([text[open_], h[open_]]), return_counts=True)
                t2 = code["f0"] if len(code) else np.zeros(0, np.int64)
                n = np.diff(first)
                one, none = np.ones(b - a, np.int64), np.zeros(len(code))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(b - a, pa.int64()), pa.array(code["f1"].view(np.int64) if len(code) else np.zeros(0, np.int64))]),
                        pa.array(np.concatenate([docs_[a:b], docs_[a:b][t2]])), pa.array(np.concatenate([tags[a:b], tags[a:b][t2]])),
                        pa.array(np.concatenate([one, none.astype(np.int64)])), pa.array(np.concatenate([n, tf_at])),
                        pa.array(np.concatenate([np.add.reduceat((~open_).astype(np.int64), first[:-1]), none.astype(np.int64)])),
                        pa.array(np.concatenate([logs, none])), pa.array(np.concatenate([fixed, none])),
                    ],
                    ["wh", "doc", "tag", "rows", "tf", "known", "logs", "fixed"],
                )

    parts = rows.select("_doc", "_tag", "_text").mapInArrow(local, "wh long, doc long, tag int, rows long, tf long, known long, logs double, fixed double")
    parts = written(parts, "parts")
    words = parts.where("wh is not null").select("wh", "doc", "tag", "tf").join(rare, "wh").groupBy("doc", "tag").agg(F.sum("tf").alias("known2"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("logs2"))
    texts = parts.where("wh is null").groupBy("doc", "tag").agg(F.sum("rows").alias("rows"), F.max("tf").alias("n"), F.max("known").alias("known"), F.max("logs").alias("logs"), F.max("fixed").alias("fixed"))
    full = texts.join(words, ["doc", "tag"], "left")
    known = F.col("known") + F.coalesce((F.col("known2") / F.col("rows")).cast("long"), F.lit(0))
    logs = F.col("logs") + F.coalesce(F.col("logs2") / F.col("rows"), F.lit(0.0))
    full = written(full.select("doc", "tag", "n", known.alias("known"), logs.alias("logs"), "fixed"), "texts")
    # Rows that repeat an id and a text are scored once above and handed out here.
    return rows.select("_id", "_doc", "_tag").join(full, (F.col("_doc") == F.col("doc")) & (F.col("_tag") == F.col("tag"))).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * float(np.log10(model.n + model.v + 1))).alias("base_score"), (F.col("logs") + F.col("fixed")).alias("score"),
    )
