"""Substring dedup over paths of word windows.

No table of all de Bruijn edges is made and nothing is compacted by joins: runs
are cut out of each text, which leaves the same paths. A window of ``length`` words is an edge of the graph from its first to its last
``length - 1`` words. Edges travel compacted: neighbouring windows of a text
that share their least gram form a path, and equal paths are one row. A path
that is the only one through its gram has no branch: all its edges have the
same occurrences, and its first owner is the least document that holds it.
Where several paths run through a gram the graph branches, and there the edges
are taken one by one, joined by their words' hash, to find the first owner of
each. Source coordinates (document, first window, number of windows) then carry
the finding back to the text, where the spans are checked against the hashes of
the words that stand there.

A word is removed if a window that covers it also starts in a document with a
smaller id.

Edge cases: null and empty texts have no words; texts of fewer words than
``length`` have no window; rows that share an id are one document and do not
remove each other's words; null ids stand behind all ids, in the order of a hash
of their text; an empty table gives no rows; other columns are not read; texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.llm.repeats import WORDS, stripped


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, gram: int = 5) -> DataFrame:
    """(id, ``n_symbols`` words, ``spans`` of removed words [start, end), ``kept`` words joined by spaces) of every row."""
    return stripped(docs, id_col, text_col, WORDS, length, gram, earlier=True)
