"""Windows of symbols that recur in a corpus, found in passes over ever fewer rows.

1. Every text is cut into runs of windows (``anchors``). Runs whose anchor
   occurs once hold no recurring window and go.
2. Runs of equal content are one class: its members share all windows. A class
   alone under its anchor is decided by its size or its first owner.
3. Only where several classes stand under one anchor (texts part there) are
   windows compared one by one, one member for each class, by their hashes.

Grouping is by hash with partial counts on the map side, and every table that
is joined back is written first, so that a frequent anchor can be split by the
planner. Rows per text are brought together last, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.anchors import RangeHash, byte_symbols, runs_of
from tessella.llm.common import release, written
from tessella.llm.words import text_chunks, word_hashes

BYTES, WORDS = "bytes", "words"
# A run travels as one long: its first window above, the number of its windows below; a text has less than 2^31 of either.
COUNT_BITS = 32
COUNT_MASK = (1 << COUNT_BITS) - 1


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _doc, _tag, _text): a null id stands behind all ids, in the order of a hash of its text; the tag tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), late).alias("_doc"), F.hash(text).alias("_tag"), text.alias("_text"))


def _symbols(kind: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kind == BYTES:
        return byte_symbols(data), offs
    h, _, _, first = word_hashes(data, offs, lower=False)
    return h, first


def run_rows(rows: DataFrame, kind: str, length: int, anchor: int) -> DataFrame:
    """(key, content, doc, tag, at) of every run; ``at`` packs the first window and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offs in text_chunks(batch.column(2)):
                symbols, first = _symbols(kind, data, offs)
                r = runs_of(symbols, first, length, anchor)
                if len(r):
                    at = (r.first - first[r.text] << COUNT_BITS) + (r.last - r.first + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.key.view(np.int64)), pa.array(r.content.view(np.int64)), pa.array(docs[a:b][r.text]), pa.array(tags[a:b][r.text]), pa.array(at.astype(np.int64))],
                        ["key", "content", "doc", "tag", "at"],
                    )

    return rows.mapInArrow(run, "key long, content long, doc long, tag int, at long")


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, index of the run of each) of packed runs."""
    n = at & COUNT_MASK
    which = np.repeat(np.arange(len(at)), n)
    return (at >> COUNT_BITS)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a list<struct> column."""
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _window_rows(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """(wh, doc, tag, n): hash of every window of the listed runs, with the size of the run's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends, (at, n) = _lists(batch.column(3), "at", "n")
            for a, b, data, offs in text_chunks(batch.column(2)):
                symbols, first = _symbols(kind, data, offs)
                hashes = RangeHash(symbols)
                own = slice(ends[a], ends[b])
                text = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                start, which = _windows(at[own])
                if len(start):
                    start = start + first[text[which]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes(start, start + length).view(np.int64)), pa.array(ids[a:b][text[which]]), pa.array(tags[a:b][text[which]]), pa.array(n[own][which].astype(np.int64))],
                        ["wh", "doc", "tag", "n"],
                    )

    return texts.mapInArrow(run, "wh long, doc long, tag int, n long")


def _own_windows(docs: DataFrame, classes: DataFrame, parted: DataFrame, kind: str, length: int, earlier: bool) -> DataFrame:
    """(doc, tag, wh): windows of parted classes that their document keeps, as their first owner or as their only one."""
    open_runs = classes.join(parted, F.col("key") == F.col("k"), "left_semi")
    asked = written(open_runs.groupBy(F.col("rep.doc").alias("_d"), F.col("rep.tag").alias("_t")).agg(F.collect_list(F.struct(F.col("rep.at").alias("at"), "n")).alias("runs")), "asked")
    texts = docs.join(asked, (F.col("_doc") == F.col("_d")) & (F.col("_tag") == F.col("_t"))).select("_doc", "_tag", "_text", "runs")
    windows = _window_rows(texts, kind, length)
    if earlier:
        return windows.groupBy("wh").agg(F.min("doc").alias("doc")).select("doc", F.lit(0).alias("tag"), "wh")
    return windows.groupBy("wh").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "tag")).alias("s")).where("n = 1").select("s.doc", "s.tag", "wh")


def recurring(docs: DataFrame, kind: str, length: int, anchor: int, earlier: bool) -> DataFrame:
    """Per _doc, the list ``_found`` of (part, tag, val).

    part 0: a run all of whose windows recur; part 1: a run whose windows recur
    except those of the text's own list; part 2: the hash of a window that is
    not removed. ``earlier``: a window recurs if a smaller id has it, else if it
    starts anywhere else.
    """
    keys = written(run_rows(docs, kind, length, anchor).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")), "keys")
    live = written(run_rows(docs, kind, length, anchor).join(keys, F.col("key") == F.col("k"), "left_semi"), "live")
    classes = written(live.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tag", "at")).alias("rep")), "classes")
    parted = written(classes.groupBy("key").agg(F.count("*").alias("f")).where("f > 1").select(F.col("key").alias("k")), "parted")
    own = written(_own_windows(docs, classes, parted, kind, length, earlier), "own")
    if earlier:
        named = classes.join(parted, F.col("key") == F.col("k"), "left").select(F.col("key").alias("_key"), F.col("content").alias("_content"), F.col("rep.doc").alias("_lo"), F.col("k").isNotNull().alias("_open"))
        part = F.when(F.col("_lo") < F.col("doc"), 0).when(F.col("_open"), 1)
    else:
        named = classes.select(F.col("key").alias("_key"), F.col("content").alias("_content"), F.col("n").alias("_n"))
        part = F.when(F.col("_n") > 1, 0).otherwise(1)
    named = written(named, "named")
    settled = live.join(named, (F.col("key") == F.col("_key")) & (F.col("content") == F.col("_content"))).select("doc", part.alias("part"), "tag", F.col("at").alias("val")).where("part is not null")
    every = settled.union(own.select("doc", F.lit(2), "tag", F.col("wh")))
    return written(every.groupBy(F.col("doc").alias("_d")).agg(F.collect_list(F.struct("part", "tag", "val")).alias("_found")), "found")


def removed_symbols(column: pa.Array, tags: np.ndarray, found: pa.Array, kind: str, length: int, own_tag: bool):
    """For every text of a batch: (row, its bytes, word starts and ends or None, mask of removed symbols)."""
    ends, (part, tag, val) = _lists(found, "part", "tag", "val")
    for a, b, data, offs in text_chunks(column):
        if kind == BYTES:
            first, starts, stops = offs, None, None
            symbols = None
        else:
            symbols, starts, stops, first = word_hashes(data, offs, lower=False)
        hashes = None
        for t in range(b - a):
            lo, hi = ends[a + t], ends[a + t + 1]
            n = int(first[t + 1] - first[t])
            mask = np.zeros(n, bool)
            if hi > lo:
                p, g, v = part[lo:hi], tag[lo:hi], val[lo:hi]
                mine = g == tags[a + t]
                edge = np.zeros(n + 1, np.int64)
                full = v[(p == 0) & mine]
                np.add.at(edge, full >> COUNT_BITS, 1)
                np.add.at(edge, (full >> COUNT_BITS) + (full & COUNT_MASK) - 1 + length, -1)
                some = v[(p == 1) & mine]
                if len(some):
                    if hashes is None:
                        hashes = RangeHash(byte_symbols(data) if symbols is None else symbols)
                    start, _ = _windows(some)
                    kept = v[(p == 2) & (mine | (not own_tag))]
                    wh = hashes(start + first[t], start + first[t] + length).view(np.int64)
                    gone = start[~np.isin(wh, kept)]
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + length, -1)
                mask = np.cumsum(edge[:n]) > 0
            words = None if starts is None else (starts[first[t] : first[t + 1]] - offs[t], stops[first[t] : first[t + 1]] - offs[t])
            yield a + t, data[offs[t] : offs[t + 1]], words, mask


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]


def stripped(docs: DataFrame, id_col: str, text_col: str, kind: str, length: int, anchor: int, earlier: bool) -> DataFrame:
    """(id, n symbols, spans of removed symbols, kept bytes) of every row of ``docs``."""
    rows = identified(docs, id_col, text_col)
    found = recurring(rows.drop("_id"), kind, length, anchor, earlier)
    release(docs.sparkSession)
    base = rows.schema["_id"].dataType.simpleString()
    joined = rows.join(found, F.col("_doc") == F.col("_d"), "left").select("_id", "_tag", "_text", "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_numpy()
            at, n, spans, kept, held = [], [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["_id", "n_symbols", "spans", "kept"],
                )

            for row, data, words, mask in removed_symbols(batch.column(2), tags, batch.column(3), kind, length, own_tag=not earlier):
                if words is None:
                    out = data[~mask].tobytes()
                else:
                    raw = data.tobytes()
                    out = b" ".join([raw[x:y] for x, y in zip(words[0][~mask].tolist(), words[1][~mask].tolist())])
                at.append(row)
                n.append(len(mask))
                spans.append(spans_of(mask) if mask.any() else [])
                kept.append(out)
                held += len(out)
                if held > 4_000_000:
                    yield flush()
                    at, n, spans, kept, held = [], [], [], [], 0
            if at:
                yield flush()

    return joined.mapInArrow(run, f"_id {base}, n_symbols long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("_id", id_col)
