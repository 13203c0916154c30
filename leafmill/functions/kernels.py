"""Counts over whole columns of text on Arrow buffers, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Bytes worked on at once (a memory bound).
PART = 4 << 20
# Signs that end a sentence, signs that may stand at the edges of a word, and vowels.
ENDS, EDGES, VOWELS = (np.isin(np.arange(256), list(signs)) for signs in (b".!?", b".,;:!?\"'()-", b"aeiouyAEIOUY"))
ASCII_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))


def spaces(buf: np.ndarray) -> np.ndarray:
    """Whether each byte is, or is part of, a white-space sign of Unicode."""
    out = ASCII_SPACE[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC2)
    lead = lead[np.isin(buf[lead + 1], (0x85, 0xA0))]
    out[lead] = out[lead + 1] = True
    lead = np.flatnonzero((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
    code = (buf[lead].astype("i4") << 16) | (buf[lead + 1].astype("i4") << 8) | buf[lead + 2]
    wide = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)
    lead = lead[np.isin(code, wide)]
    out[lead] = out[lead + 1] = out[lead + 2] = True
    return out


def counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, words, sentences, syllables) of each row.

    Tokens are parted by white space alone.  Words are parted by white space and ends of sentences; a sentence is what
    stands between ends and isn't blank.  A word has its vowel groups, less one
    for a final e (not le) or ed, and at least one; one of three letters or fewer
    has one.  Signs at its edges don't count.
    """
    rows = len(offsets) - 1
    if not len(buf):
        return (np.zeros(rows, "i4"),) * 4
    head = offsets[:-1][offsets[:-1] < len(buf)]

    def starts(mask: np.ndarray) -> np.ndarray:
        """Places where a run of ``mask`` begins within its row."""
        before = np.zeros(len(buf), bool)
        before[1:] = mask[:-1]
        before[head] = False
        return np.flatnonzero(mask & ~before)

    def by_row(at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=rows)

    blank, ends = spaces(buf), ENDS[buf]
    tokens = by_row(starts(~blank))
    inside = ~(blank | ends)
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, stop = starts(inside), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(row, minlength=rows)
    marks = np.cumsum(ends)[start] if len(start) else np.zeros(0, "i8")
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (marks[1:] != marks[:-1])
    sentences = np.bincount(row[new], minlength=rows)
    core = np.flatnonzero(inside & ~EDGES[buf])
    i, j = np.searchsorted(core, start), np.searchsorted(core, stop) - 1
    full = i <= j
    first, last = core[i[full]], core[j[full]]
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    signs = total((buf & 0xC0) != 0x80)
    group = np.zeros(len(buf), bool)
    group[starts(VOWELS[buf])] = True
    groups = total(group)
    low = buf | 0x20
    tail, prior = low[last], np.where(last > first, low[np.maximum(last - 1, 0)], 0)
    taken = ((tail == ord("e")) & (prior != ord("l"))) | ((tail == ord("d")) & (prior == ord("e")))
    n = np.ones(len(start), "i8")
    n[full] = np.where(signs[last + 1] - signs[first] <= 3, 1, np.maximum(1, groups[last + 1] - groups[first] - taken))
    return tokens.astype("i4"), words.astype("i4"), sentences.astype("i4"), np.bincount(row, n, minlength=rows).astype("i4")


@F.arrow_udf(StructType().add("tokens", IntegerType()).add("words", IntegerType()).add("sentences", IntegerType()).add("syllables", IntegerType()))
def text_counts(text: pa.Array) -> pa.Array:
    """``counts`` of a column; null counts as empty."""
    column = text.cast(pa.large_binary()).fill_null(b"")
    parts: list[tuple[np.ndarray, ...]] = []
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(column.buffers()[2], "u1") if len(column) and column.buffers()[2] is not None else np.zeros(0, "u1")
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1)
        j = min(j, len(column))
        parts.append(counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    columns = [np.concatenate(c) if parts else np.zeros(0, "i4") for c in (zip(*parts, strict=True) if parts else ((), (), (), ()))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["tokens", "words", "sentences", "syllables"])
