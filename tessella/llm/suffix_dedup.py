"""Suffix dedup of byte strings: suffixes grouped through their first ``length`` bytes.

Of the order of suffixes only it matters which are equal that far. No order is
made (a radix sort by leading bytes would make one); groups are split by hashes
in passes from the coarsest on, and a suffix leaves as soon as it is alone:

* first pass: the suffix's anchor, the least ``length / 2``-byte gram among
  those in its first ``length`` bytes. Suffixes of one anchor travel as one row;
* second pass: the whole content under the anchor; equal contents are equal
  groups of suffixes, settled together;
* last pass, where contents part: the full ``length`` bytes of each suffix of
  one row per content. Groups of one are the suffixes that occur once.

Equal groups at the end are the repeated windows (equal 64-bit hashes are taken for equal); all bytes that one
covers are removed. The first pass does not take the first bytes of the suffix: a row
for every suffix of a byte text costs some eight times the text in shuffles,
and the anchor gives the same groups from a row for every fifty suffixes.

Edge cases: null and empty texts have no bytes; texts shorter than ``length``
have no window; a text repeated as a row is its own copy and goes whole if long
enough; rows that share an id are told apart by their text; null ids are kept
and their rows take part; an empty table gives no rows; other columns are not
read; texts of any length are read whole, and no window crosses texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.llm.repeats import BYTES, stripped


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, ``n_symbols`` bytes, ``spans`` of removed bytes [start, end), ``kept`` bytes) of every row."""
    return stripped(docs, id_col, text_col, BYTES, length, length // 2, earlier=False)
