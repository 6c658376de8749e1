"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

Documents become token ids and a closing id; only documents longer than a
sequence are cut. Which piece goes where depends on lengths alone, and there are
at most ``max_tokens`` of them, so best-fit decreasing runs on the driver over
counts of lengths: sequences with equal room are one group that is filled or
split as a whole. The plan is a list of slot ranges for each length (at most a
few for every length and group, whatever the number of documents). Pieces are
numbered within their length and take the slot of their number by a join.

Numbering needs no order over the table: the pieces are written once, every
task's pieces of a length are numbered by themselves, and a running count of the
tasks before shifts them.

Edge cases: a null or empty text is its closing id alone; a null id stays null;
rows that repeat an id are packed as documents of their own; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.words import text_chunks

#: Words that a worker remembers; longer ones are encoded each time.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 64

#: Words sent to the tokenizer as one text.
TOGETHER = 500

_BREAK = np.isin(np.arange(256), [32, 9, 10, 13])
#: A word and the marks behind it: the tokenizer parts letters and digits from marks.
_TAILED = re.compile(rb"([^<]*[0-9A-Za-z])([.,;:!?]+)", re.DOTALL)
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_LOADED: dict[str, Words] = {}


def word_tokenizer() -> str:
    """Path of the public vocabulary whose words end at white space."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """A tokenizer that parts words at white space, with a worker's memory of words as packed ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary, mark = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word; new ones are parted into stem and marks first, as many words share a stem."""
        out = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        parts = []
        for k in new:
            stem, tail = m.groups() if (m := _TAILED.fullmatch(words[k])) else (words[k], b"")
            parts.append((stem.lower() if stem.isascii() and b"<" not in stem else stem, tail))
        fresh = self.encode_new([x for x in dict.fromkeys(chain.from_iterable(parts)) if x and x not in self.known])
        if len(self.known) > CACHED_WORDS:
            fresh.update((x, self.known[x]) for x in chain.from_iterable(parts) if x in self.known)
            self.known.clear()
        self.known.update((x, ids) for x, ids in fresh.items() if len(x) <= CACHED_BYTES)
        for k, (stem, tail) in zip(new, parts):
            out[k] = b"".join(fresh[x] if x in fresh else self.known[x] for x in (stem, tail) if x)
            if len(words[k]) <= CACHED_BYTES:
                self.known[words[k]] = out[k]
        return out

    def encode_new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters alone are one unit each: they are encoded side by side and parted behind their ends."""
        texts = [w.decode() for w in words]
        plain = [_LETTERS.fullmatch(t) is not None for t in texts] if self.ends.any() else [False] * len(texts)
        side = [t for t, p in zip(texts, plain) if p]
        apart = [t for t, p in zip(texts, plain) if not p]
        encode = lambda x: (e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False))
        done = {t: np.array(ids, np.uint32).tobytes() for t, ids in zip(apart, encode(apart))}
        for k, ids in enumerate(encode([" ".join(side[i : i + TOGETHER]) for i in range(0, len(side), TOGETHER)])):
            ids = np.array(ids, np.uint32)
            packed, edges = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            done.update((t, packed[a:b]) for t, a, b in zip(side[k * TOGETHER :], edges[:-1], edges[1:], strict=False))
        return {w: done[t] for w, t in zip(words, texts)}


def _encoder(path: str) -> Words:
    """The tokenizer and the memory of words, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def encode_texts(data: np.ndarray, offs: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, each closed by ``end_id``, and the place of each text's first id (one entry more than texts).

    White space separates tokens, so every distinct word is encoded once.
    """
    word = ~_BREAK[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offs)
    ids, ends = np.zeros(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        edges = np.append(np.cumsum(word)[starts] - 1, word.sum()).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[word])])
        coded = column.dictionary_encode()
        of = np.asarray(coded.indices)
        packed = _encoder(path).encode(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        flat = np.frombuffer(b"".join(packed), np.uint32)
        took = sizes[of]
        ends[1:] = np.cumsum(took)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], took) + np.arange(ends[-1])]
    bounds = ends[first]
    out = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
    return out, bounds + np.arange(len(bounds))


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids) with the ids as little-endian unsigned 32-bit numbers."""
    path = tokenizer or word_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                ids, at = encode_texts(data, offs, path, end_id)
                size = np.diff(at)
                n = -(-size // max_tokens)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(size[doc] - start, max_tokens)
                edges = (np.append(at[:-1][doc] + start, at[-1]) * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


def plan_slots(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first number, end number, first sequence, slots in each sequence, offset).

    A group is a run of sequences with the same tokens used. An item goes to the
    sequence with the least room that holds it, which then has less room still,
    so a sequence takes as many items of the length as it holds before the next.
    """
    if any(not 1 <= size <= max_tokens for size in histogram):
        raise ValueError(f"lengths must lie between 1 and {max_tokens}")
    slots, next_sequence = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    rooms: list[int] = []  # those of groups, in order

    def keep(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, number = histogram[size], 0
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, n = max_tokens, next_sequence, -(-left // (max_tokens // size))
                next_sequence += n
            each = room // size
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for begin, count, took in ((first, full, each), (first + full, min(rest, 1), rest)):
                if count and took:
                    slots.append((size, number, number + count * took, begin, took, max_tokens - room))
                    number += count * took
                    left -= count * took
                    keep(room - took * size, begin, count)
            used = full + min(rest, 1)
            keep(room, first + used, n - used)
    return slots


def place(pieces: DataFrame, *, max_tokens: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    own = pieces.columns
    cut = written(pieces.withColumn("_task", F.spark_partition_id()), "pieces")
    by_task = written(cut.groupBy(F.col("length").alias("_size"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in by_task.groupBy("_size").agg(F.sum("_n")).collect()}  # max_tokens rows at most
    slots = spark.createDataFrame(plan_slots(histogram, max_tokens), "_length long, _lo long, _hi long, _sequence long, _each long, _offset long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = by_task.select("_size", "_of", before.alias("_before"))
    within = Window.partitionBy("length", "_task").orderBy("doc_id", "piece", F.xxhash64(*own))
    numbered = (
        cut.withColumn("_nth", F.row_number().over(within))
        .join(shift, (F.col("length") == F.col("_size")) & (F.col("_task") == F.col("_of")))
        .withColumn("_number", F.col("_before") + F.col("_nth") - 1)
    )
    taken = numbered.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_lo")) & (F.col("_number") < F.col("_hi")))
    inside = F.col("_number") - F.col("_lo")
    return taken.select(
        *own,
        (F.col("_sequence") + F.floor(inside / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(inside, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """Every piece of every document with its ids and its place."""
    return place(token_pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id, max_tokens=max_tokens), max_tokens=max_tokens)
