"""Windows of texts gathered under anchors.

The windows of ``length`` symbols of a text are cut into runs: neighbouring
windows whose least ``anchor``-gram (by hash, the last of equals) is the same
one. A run is a function of its symbols, so equal windows always stand under
equal anchors, at the same distance: windows that are equal anywhere share the
anchor's hash, and runs with equal content share all their windows. Rows per
anchor, not per window, are what needs to travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessella.llm.words import _BYTE, mix, powers

_BASE = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class RangeHash:
    """Hashes of any ranges of a symbol sequence, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(max(n, 1), np.uint64(_BASE))[:n], out=self.prefix[1:])
        self.back = powers(n + 1, _INVERSE)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.back[a])


@dataclass
class Runs:
    """Runs of windows: the windows start at ``first`` to ``last`` (both included)."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    content: np.ndarray
    hashes: RangeHash | None

    def __len__(self) -> int:
        return len(self.text)


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` neighbours, the last of equals."""
    n = len(grams) - width + 1
    best, span = np.arange(len(grams), dtype=np.int32), 1

    def better(x, y):
        return np.where(grams[y] <= grams[x], y, x)

    while span * 2 <= width:
        best = better(best[: len(best) - span], best[span:])
        span *= 2
    return better(best[:n], best[width - span : width - span + n])


def runs_of(symbols: np.ndarray, first: np.ndarray, length: int, anchor: int) -> Runs:
    """The runs of all texts of a chunk; text t has the symbols [first[t], first[t + 1])."""
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), None)
    hashes = RangeHash(symbols)
    at = np.arange(len(symbols) - anchor + 1)
    grams = hashes(at, at + anchor)
    least = _least(grams, length - anchor + 1)
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if len(start) == 0:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), None)
    least, ends = least[start], ends[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (ends[1:] != ends[:-1])
    head = np.flatnonzero(new)
    a, b = start[head], start[np.append(head[1:], len(start)) - 1]
    content = mix(hashes(a, b + length) + (b - a).astype(np.uint64))
    return Runs(np.searchsorted(first, a, side="right") - 1, a, b, grams[least[head]], content, hashes)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]
