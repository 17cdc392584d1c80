"""A run-length index of many short strings: which bounded matches occur in a string of a lower owner.

The strings are put in a row in order of owner, each closed by a byte that UTF-8 never uses. Rows of the
Burrows-Wheeler transform are sorted by their first `width` bytes and then by place, which keeps backward
search exact for matches of up to that many bytes. Only its runs are kept: a run ends where the transformed
byte or the width-byte prefix changes, and its head keeps a sample of its place in the text. The rows of one
prefix start with a run head, and the sample there is the occurrence with the lowest owner.

Strings are streamed through the index from right to left, many side by side: the matching statistic at each
place is the interval of rows that start with the longest match up to width bytes. A string of the index matches
itself, so no interval is empty and its first row tells all. A stream starts in the interval of the string's last
width - 1 bytes, which construction leaves behind; when a match is width bytes long, its last byte is dropped (the
interval grows to that of its first width - 1 bytes) before the next one is put in front.
"""

from __future__ import annotations

import numpy as np

CLOSE = 255


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys below 2 ** (63 - bits of a place); one sort of values, with the places in their low bits."""
    n = len(keys)
    bits = max(1, (n - 1).bit_length())
    both = np.sort((keys << bits) | np.arange(n))
    place, keys = both & ((1 << bits) - 1), both >> bits
    fresh = np.zeros(n, np.int64)
    fresh[1:] = keys[1:] != keys[:-1]
    ranks = np.empty(n, np.int64)
    ranks[place] = np.cumsum(fresh)
    return ranks


def _ahead(values: np.ndarray, by: int, past: int) -> np.ndarray:
    out = np.full(len(values), past, np.int64)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


class RunIndex:
    def __init__(self, text: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int = 50):
        """text: the bytes of all strings in a row, each followed by CLOSE; owners must ascend."""
        self.width, self.owners, self.lengths = width, owners, lengths
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.text, n = text, len(text)
        self.n = n
        bits = max(1, (n - 1).bit_length())
        used = np.bincount(text, minlength=256) > 0
        letters = np.cumsum(used)[text]  # from 1; 0 is past the end
        size = int(used.sum()).bit_length()
        # Rank by as many letters as fit in a key, then by twice as many, and so on.
        span = max(1, min((63 - bits) // size, width - 1))
        ranks = np.zeros(n, np.int64)
        for k in range(span):
            ranks = (ranks << size) | _ahead(letters, k, 0)
        ranks = _ranks(ranks) + 1
        while span < width - 1:
            step = min(span, width - 1 - span)  # spans may overlap: equal starts leave the order to the rest
            ranks, span = self._paired(ranks, _ahead(ranks, step, 0), bits), span + step
        shorter = ranks
        full = self._paired(shorter, _ahead(letters, width - 1, 0), bits)
        sorted_rows = np.sort((full << bits) | np.arange(n))
        rows, full = sorted_rows & ((1 << bits) - 1), sorted_rows >> bits
        before = text[rows - 1]  # row 0 of the text: its last byte, a closing one
        heads = np.ones(n, bool)
        heads[1:] = (before[1:] != before[:-1]) | (full[1:] != full[:-1])
        self.run_start = np.flatnonzero(heads)
        of_place = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.run_owner = owners[of_place[rows[self.run_start]]]  # of the sampled place
        run_byte = before[self.run_start].astype(np.int64)
        run_length = np.diff(np.append(self.run_start, n))
        # Runs of a byte follow each other in key order, so a rank plus the number of smaller bytes is one running sum.
        if 8 + 2 * (bits + 1) <= 63:
            packed = np.sort((run_byte << 2 * (bits + 1)) | (self.run_start << (bits + 1)) | run_length)
            self.key_length = packed & ((2 << bits) - 1)
            self.key = (packed >> 2 * (bits + 1)) * (n + 1) + ((packed >> (bits + 1)) & ((2 << bits) - 1))
        else:
            order = np.argsort(run_byte, kind="stable")
            self.key, self.key_length = run_byte[order] * (n + 1) + self.run_start[order], run_length[order]
        self.counted = np.cumsum(self.key_length) - self.key_length
        in_order = shorter[rows]
        edge = np.ones(n, bool)
        edge[1:] = in_order[1:] != in_order[:-1]
        self.wide_start = np.flatnonzero(edge)
        self.wide_of = shorter - 1  # the group of width - 1 equal bytes of each place of the text

    @staticmethod
    def _paired(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
        """Dense ranks from 1 of pairs of ranks; pairs that are too wide for one key are ranked by two sorts."""
        extra = max(1, int(second.max(initial=0)).bit_length())
        high = max(1, int(first.max(initial=0)).bit_length())
        if high + extra + bits <= 63:
            return _ranks((first << extra) | second) + 1
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        fresh = np.zeros(len(a), np.int64)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.empty(len(a), np.int64)
        out[order] = np.cumsum(fresh) + 1
        return out

    def _extended(self, byte: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row that row bound `at` goes to when byte is put in front of all rows below it."""
        place = np.searchsorted(self.key, byte * (self.n + 1) + at, side="left") - 1
        known = np.maximum(place, 0)
        run_at = self.key[known] - byte * (self.n + 1)  # negative if the run is of a lower byte
        inside = np.where((place >= 0) & (run_at >= 0), np.minimum(at - run_at, self.key_length[known]), self.key_length[known])
        return np.where(place >= 0, self.counted[known] + inside, 0)

    def lower_matches(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches of width bytes in the chosen strings that a lower owner has too: (string, place in it)."""
        chosen = chosen[self.lengths[chosen] >= self.width]
        chosen = chosen[np.argsort(-self.lengths[chosen], kind="stable")]
        windows = self.lengths[chosen] - self.width + 1
        strings, places = [], []
        at = self.wide_start[self.wide_of[self.starts[chosen] + windows]]
        for step in range(int(windows.max(initial=0))):
            live = int(np.searchsorted(-windows, -step, side="left"))  # strings with more windows than step
            place = windows[:live] - 1 - step
            byte = self.text[self.starts[chosen[:live]] + place].astype(np.int64)
            row = self._extended(byte, at[:live])
            owner = self.run_owner[np.searchsorted(self.run_start, row, side="right") - 1]
            lower = np.flatnonzero(owner < self.owners[chosen[:live]])
            strings.append(chosen[lower])
            places.append(place[lower])
            at = self.wide_start[np.searchsorted(self.wide_start, row, side="right") - 1]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *strings]), np.concatenate([none, *places])
