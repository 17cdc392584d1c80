"""Vectorised hashes over the bytes of a column of texts.

Hashes are polynomials in an odd 64-bit base, modulo 2 ** 64, with the bits mixed at the end; the hash of any
range of bytes is one difference of running sums, so every range of a batch costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ... size - 1 modulo 2 ** 64."""
    out = np.full(size, base % 2**64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (size - 1).bit_length()))[:size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column in a row, and the places where each one starts and the last one ends."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(part: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """part in pieces of about limit bytes of text (a longer text is a piece of its own), which bounds the arrays made of it."""
    size = pa.compute.fill_null(pa.compute.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), part.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield part.slice(a, b - a)


class Ranges:
    """Hashes of ranges of raw."""

    def __init__(self, raw: np.ndarray, base: int = BASES[0]):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw)), out=self.sums[1:])
        self.inverse = pow(base, -1, 2**64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(self.inverse, len(self.sums))
        return mixed((self.sums[end] - self.sums[start]) * back[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of raw[i : i + width] for every i that has so many bytes."""
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * powers(self.inverse, n))


def shingles(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct width-word shingles of each text, ascending within a text: (hashes, where each text starts).

    Words are runs of bytes other than ASCII white space. A text of fewer words has one shingle of all of
    them; a text without words has none.
    """
    texts = len(at) - 1
    inside = ~BLANKS[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    starts[first] = inside[first]
    start = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = inside[last]
    words = Ranges(raw).of(start, np.flatnonzero(ends) + 1)
    of_text = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(of_text, minlength=texts)
    begin = np.zeros(texts + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    # The shingle that starts at each word: a polynomial over the words' hashes.
    total = np.zeros(len(words), np.uint64)
    step = np.uint64(BASES[1])
    for j in range(width):
        total *= step
        total[: len(words) - j] += words[j:]
    room = np.repeat(begin[1:], count) - np.arange(len(words))
    full = room >= width
    hashes, owner = mixed(total[full]), of_text[full]
    if short := [t for t in np.flatnonzero((count > 0) & (count < width))]:
        whole = [int(sum(int(w) * pow(BASES[1], int(count[t]) - 1 - k, 2**64) for k, w in enumerate(words[begin[t] : begin[t + 1]])) % 2**64) for t in short]
        whole = mixed(np.array(whole, np.uint64) ^ np.uint64(0x5851F42D4C957F2D) * count[short].astype(np.uint64))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner)) if texts > 1 else np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    begin = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=texts), out=begin[1:])
    return hashes, begin
