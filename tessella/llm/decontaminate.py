"""Benchmark decontamination: one Aho-Corasick automaton, one scan of the texts.

Items (questions and answers) and texts are normalised alike: A-Z lower-cased,
words are runs of ASCII letters, digits and non-ASCII characters. Every run of
``window`` item words (or a whole shorter item) is one pattern of an automaton
over word numbers. A text is scanned once; hits are word positions and are
mapped back to character offsets of the untouched text.

Edge cases: a null or empty text has no words and no hits; null or wordless
items give no pattern; windows of an item with a null id hit words, but the item
is not listed; equal items all count as found; repeated text rows are
scanned one by one; an empty item table leaves every text clean; other columns
of the inputs are never read. A text of any length is scanned whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Item bytes held by one automaton. Item tables beyond it are dealt over several
# automata by hash, which the same pass applies one after another.
AUTOMATON_BYTES = 4_000_000

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BUILT: dict[tuple[str, int], list] = {}


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Character span of every word of the untouched text, in order."""
    return [m.span() for m in _WORD.finditer(text)]


def _automaton(items: list[tuple[str | None, str]], window: int):
    import ahocorasick

    numbers: dict[bytes, int] = {}
    patterns: dict[tuple, set] = {}
    for item_id, text in items:
        seq = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
        for i in range(max(1, len(seq) - window + 1) if seq else 0):
            owners = patterns.setdefault(seq[i : i + window], set())
            if item_id is not None:
                owners.add(item_id)
    if not patterns:
        return numbers, None
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, owners in patterns.items():
        auto.add_word(seq, (len(seq), sorted(owners)))
    auto.make_automaton()
    return numbers, auto


def _built(handle, window: int):
    """The automaton of a broadcast item table, made once in each worker."""
    token, shards = handle.value
    if (key := (token, window)) not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [_automaton(shard, window) for shard in shards]
    return _BUILT[key]


def scan_text(text: str | None, automata: list[tuple]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(number of words, hit word runs [from, to), items found)."""
    words = words_of(text)
    found: set[str] = set()
    spans: list[tuple[int, int]] = []
    for numbers, auto in automata:
        if auto is None or not words:
            continue
        for last, (length, owners) in auto.iter(tuple([numbers.get(w, 0) for w in words])):
            found.update(owners)
            spans.append((last - length + 1, last + 1))
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return len(words), runs, sorted(found)


def _shared(items: DataFrame, item_id: str, item_text: str):
    """The items dealt over as many automata as their size asks for, sent to the tasks."""
    pool = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = pool.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = int(size // AUTOMATON_BYTES) + 1
    shards = [[(r["i"], r["t"]) for r in pool.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).distinct().collect()] for k in range(n)]
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, shards))


def hit_words(items: DataFrame, text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> Column:
    """Number of words of ``text_col`` that stand in a window of the items."""
    handle = _shared(items, item_id, item_text)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = _built(handle, window)
        for batch in batches:
            yield pd.Series([sum(b - a for a, b in scan_text(t, automata)[1]) for t in batch], dtype="int64")

    return F.pandas_udf(run, "long")(F.col(text_col))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 10,
) -> DataFrame:
    """One row per text: id, ``n_words``, ``n_hit``, ``items`` found, ``spans`` of hit characters [start, end)."""
    handle = _shared(items, item_id, item_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = _built(handle, window)
        for batch in batches:
            out = []
            for key, text in zip(batch["k"], batch["t"]):
                n, runs, found = scan_text(text, automata)
                spans: list[tuple[int, int]] = []
                if runs:
                    at = word_offsets(text)
                    spans = [(at[a][0], at[b - 1][1]) for a, b in runs]
                out.append((key, n, sum(b - a for a, b in runs), found, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["k", "n_words", "n_hit", "items", "spans"]).astype({"k": object})

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
        .mapInPandas(run, f"k {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
        .withColumnRenamed("k", id_col)
    )
