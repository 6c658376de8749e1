"""Words and shingles of whole texts as 64-bit hashes, over the buffers of an Arrow column.

Words are runs of bytes other than ASCII white space. Word hashes are
polynomials over the bytes with random byte values, modulo 2**64, then mixed;
all arithmetic is whole-array, so a text of any length costs the same per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COEFFS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a string column in slices of about ``limit`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the first word of each text (one entry more than texts)."""
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offs), np.int64)
    at = np.flatnonzero(word)
    head = np.flatnonzero(begin[at])
    sizes = np.diff(np.append(head, len(at)))
    rank = np.arange(len(at)) - np.repeat(head, sizes)
    values = _BYTE[data[at]] * powers(int(sizes.max()))[rank]
    return mix(np.add.reduceat(values, head)), starts, starts + sizes, np.searchsorted(starts, offs)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on; text borders are the caller's."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _COEFFS[j]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle; its length is part of it."""
    out = np.array([len(h) + 1], np.uint64)
    for x in h:
        out = mix(out * _STEP + x)
    return out[0]


def shingle_set(h: np.ndarray, all_shingles: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Sorted distinct shingles of the words [a, b) of a chunk; one for a shorter sequence, none without words."""
    if b - a >= k:
        return np.unique(all_shingles[a : b - k + 1])
    return np.array([sequence_hash(h[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64)
