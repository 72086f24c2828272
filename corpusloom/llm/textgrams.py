"""Words and word n-grams of whole batches of texts as 64-bit hashes, in numpy.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A word's
hash is a polynomial over random values of its bytes, taken from one running sum over the batch, and mixed; n-grams
combine the hashes of n words. Equal words have equal hashes in every process and batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a running sum; the tables of powers have this length, whatever the texts.
CHUNK = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = 0xD1342543DE82EF95
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64) -> np.ndarray:
    values = np.full(CHUNK + 1, base, np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


UP, DOWN = _powers(BASE), _powers(BASE_INVERSE)


def _long_word(data: np.ndarray) -> np.uint64:
    """The polynomial of one word over CHUNK bytes, piece by piece."""
    total = 0
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        part = int((BYTE_VALUES[piece] * UP[: len(piece)]).sum(dtype=np.uint64))
        total += part * pow(int(BASE), at, 1 << 64)
    return np.uint64(total % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of a batch: hashes, byte positions, and for each text where its words begin (one more at the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, one more at the end; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    solid = ~BLANK[data]
    begins, finishes = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= solid[edges]
        finishes[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        if hi - lo > CHUNK:
            hashes[i] = mix(_long_word(data[lo:hi])[None])[0]
        else:
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            np.cumsum(BYTE_VALUES[data[lo:hi]] * UP[: hi - lo], out=total[1:])
            at = starts[i:j] - lo
            hashes[i:j] = mix((total[ends[i:j] - lo] - total[at]) * DOWN[at])
        i = j
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def _grown(h: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Unmixed n-gram hashes for n = 1, 2, 4, ... up to size; position i covers words i to i + n - 1 of the batch."""
    out, n = {1: h}, 1
    while n * 2 <= size:
        prev = out[n]
        out[n * 2] = prev[: len(prev) - n] * np.uint64(pow(STEP, n, 1 << 64)) + prev[n:] if len(prev) > n else prev[:0]
        n *= 2
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of the batch, also those that cross texts; the caller leaves these out."""
    if len(h) < n:
        return h[:0]
    parts = _grown(h, n)
    size = max(k for k in parts if k <= n)
    out, have = parts[size], size
    while have < n:
        take = max(k for k in parts if k <= n - have)
        more = parts[take][have:]
        out = out[: len(more)] * np.uint64(pow(STEP, take, 1 << 64)) + more
        have += take
    return mix(out[: len(h) - n + 1] + np.uint64(n))


SLICE = 2 << 20


def slices(batch: pa.RecordBatch, column: int) -> list[pa.RecordBatch]:
    """A batch in parts of at most SLICE bytes of text each, or of one row."""
    values = batch.column(column)
    if not len(values):
        return [batch]
    _, offsets = text_bytes(values)
    out, at = [], 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        out.append(batch.slice(at, to - at))
        at = to
    return out


def text_parts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray, n: int = 1, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets within them, number of the first text): groups of whole texts up to `size` bytes, and longer texts in
    parts. A part begins n - 1 words before the end of the last one, so each run of n words lies in exactly one. gap: the bytes that
    are of no word."""
    i = 0
    while i < len(offsets) - 1:
        to = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[to])
        if hi - lo <= size:
            yield data[lo:hi], offsets[i : to + 1] - lo, i
            i = to
            continue
        held = size
        while lo < hi:
            end = min(lo + held, hi)
            while end < hi and not gap[data[end]]:  # not within a word
                end += 1
            part = data[lo:end]
            if end == hi:
                yield part, np.array([0, end - lo]), i
                break
            solid = ~gap[part]
            begins = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
            if len(begins) < n:
                if not len(begins):  # nothing but gaps, which no run of words spans
                    lo = end
                held = size if not len(begins) else held * 2
                continue
            yield part, np.array([0, end - lo]), i
            lo, held = lo + int(begins[len(begins) - n + 1]) if n > 1 else end, size
        i = to
