"""Whole-column text kernels on Arrow buffers: tokens and hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that aren't white space, and the number of tokens of each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~IS_SPACE[buf]
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash, one longer than ``buf``."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((LOWER[buf] if lower else buf).astype(np.uint64).__iadd__(np.uint64(1)) * _power(BASE, "up", len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever the span stands."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * _power(INVERSE, "down", len(prefix))[starts])


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the number of tokens of each row."""
    starts, ends, counts = tokens(buf, offsets)
    return span_hash(prefix_hash(buf, lower), starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a row with fewer words (but some) has one run of all of them."""
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(len(words))
    left = np.repeat(ends, counts) - at
    first = np.repeat(ends - counts, counts) == at
    keep = (left >= width) | (first & (np.repeat(counts, counts) < width))
    at, rows, left = at[keep], rows[keep], left[keep]
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            inside = left > k
            value = np.where(inside, words[np.minimum(at + k, len(words) - 1)] if len(words) else h, np.uint64(0x51ED270B))
            h = mix(h * np.uint64(0xD1342543DE82EF95) + value + np.uint64(k + 1))
    return h, rows
