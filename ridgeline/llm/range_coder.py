"""An adaptive context-mixing range coder for token ids.

Every block starts with empty models. For each id, an order-2 table (what followed the two ids before it) and an
order-1 table (what followed the one before it) each give an id with a confidence of four levels, and the order-0
model gives every id a frequency: ids lie in BINS bins, narrow ones for low ids, which merge-ranked vocabularies use
most; a bin's share is counted, and shared alike by its ids. The prediction is the mixture

    w2 [id = order-2 guess] + w1 [id = order-1 guess] + w0 frequency(id)

whose weights are chosen by the two confidences (and whether the guesses agree) and learned from how often each part
was right in that state. The mixture drives a range coder with 48 bits of range and words of 16 bits. Frequencies
and weights are counted for every id and taken over at fixed steps, so that both directions see the same numbers.

Blocks are independent, so a task codes many of them side by side: each array operation makes one step of all
blocks. The arithmetic is on integers, and on doubles in single operations, whose results are the same everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
#: Blocks side by side; a task holds some 80 kB of models, ids and words for each.
LANES = 1024
CONTEXTS = 1024
BINS = 256
STATES = 32  # confidence of order 2, confidence of order 1, whether they agree
EPOCH = 128
MIX_BITS, ID_BITS = 12, 22
#: Cells of the frequency range for which the first bin is looked up.
CELL_BITS = 10
HEADER = struct.Struct("<4sBII")  # magic, symbols of an id, ids, words
MAGIC = b"TCM2"
#: A part of the mixture has at least this share, so that the range left for an id's frequency stays wide enough.
FLOOR = 2 ** (MIX_BITS - 6)
FULL, LEAST = np.uint64(2**48), np.uint64(2**32)

_EDGES = np.floor(65536 * np.expm1(4.5 * np.arange(BINS + 1) / BINS) / np.expm1(4.5)).astype(np.int64)
_WIDTHS = np.diff(_EDGES)
_BIN_OF = np.repeat(np.arange(BINS), _WIDTHS)
#: Confidence after a wrong guess (first four) and after a right one.
_CONFIDENCE = np.array([0, 0, 1, 2, 1, 2, 3, 3], np.int32)


class _Models:
    """The models of a number of blocks, at their start."""

    def __init__(self, lanes: int, lookup: bool = False):
        self.lookup = lookup
        self.tables = np.zeros(2 * lanes * CONTEXTS, np.int32)  # order 2, then order 1: id * 4 + confidence
        self.base = np.stack([np.arange(lanes) * CONTEXTS, (lanes + np.arange(lanes)) * CONTEXTS])
        self.lane = np.arange(lanes)
        self.seen = np.ones((lanes, BINS))
        right = np.array([[1, 1, 1, 1, 4, 4, 4, 4, 8, 8, 8, 8, 16, 16, 16, 16], [1, 4, 8, 16] * 4]).repeat(2, axis=1)
        self.parts = np.stack([*right, np.full(STATES, 8)], axis=1)[None].repeat(lanes, axis=0).astype(float)
        self.steps = 0
        self.refresh()

    def at(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places in the tables, for two and for one id of context; a row of two for each row of ids."""
        one = last * 0x9E3779B1
        two = one + before * 0x85EBCA6B
        return np.stack([(two >> 13) & (CONTEXTS - 1), (one >> 15) & (CONTEXTS - 1)], axis=-2) + self.base[:, : last.shape[-1]]

    @staticmethod
    def corrected(guess: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The table entries after ids were seen."""
        sure = guess & 3
        right = (guess >> 2) == ids
        fresh = ids << 2
        # Selections by product: a branch for each element costs far more.
        return fresh + (right | (sure > 1)) * (guess - sure - fresh) + _CONFIDENCE.take(sure + 4 * right)

    @staticmethod
    def state(two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return ((two & 3) * 4 + (one & 3)) * 2 + (two >> 2 == one >> 2)

    def learn(self, state: np.ndarray, event: np.ndarray, bins: np.ndarray) -> None:
        """Counts an epoch: arrays of steps by lanes, of the lanes that were there at its start."""
        lanes = state.shape[1]
        lane = self.lane[:lanes]
        self.parts[:lanes] += np.bincount(((lane * STATES + state) * 3 + event).ravel(), minlength=lanes * STATES * 3).reshape(lanes, STATES, 3)
        self.seen[:lanes] += np.bincount((lane * BINS + bins).ravel(), minlength=lanes * BINS).reshape(lanes, BINS)
        self.steps += len(state)
        self.refresh(lanes)

    def refresh(self, lanes: int | None = None) -> None:
        parts, seen = self.parts[:lanes], self.seen[:lanes]
        weights = (parts[:, :, :2] * (2**MIX_BITS - 3 * FLOOR) / parts.sum(axis=2, keepdims=True)).astype(np.uint64) + np.uint64(FLOOR)
        self.two_width, self.one_width = (np.ascontiguousarray(weights[:, :, k]).ravel() for k in (0, 1))
        share = (2**ID_BITS - 65536) / (BINS + self.steps) / _WIDTHS
        each = (seen * share).astype(np.int64) + 1
        upto = np.zeros((len(each), BINS + 1), np.int64)
        np.cumsum(each * _WIDTHS, axis=1, out=upto[:, 1:])
        self.upto = upto.astype(np.int32).ravel()
        if self.lookup:
            # The bin of the first value of each cell: the number of bins that end at or before it.
            ends = -(-upto[:, 1:] >> (ID_BITS - CELL_BITS))
            ends += self.lane[: len(each), None] << CELL_BITS
            first = np.bincount(ends.ravel(), minlength=(len(each) << CELL_BITS) + 1)[: len(each) << CELL_BITS].reshape(len(each), -1)
            self.first = np.cumsum(first, axis=1, dtype=np.int16).ravel()


def _epochs(longest: int) -> list[tuple[int, int]]:
    """Short ones first, while the counts are few."""
    cuts = [0, 4, 8, 16, 32, *range(EPOCH, longest, EPOCH)]
    cuts = [c for c in cuts if c < longest]
    return list(zip(cuts, [*cuts[1:], longest]))


def _live(lengths: np.ndarray, longest: int) -> np.ndarray:
    """For each step the number of lanes that are longer; lengths fall."""
    return np.searchsorted(-lengths, -np.arange(longest), side="left")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block: header, coded words, crc32 of all before."""
    found: list[bytes] = [b""] * len(blocks)
    wide = [bool(len(b)) and int(b.max()) >= 2**16 for b in blocks]
    for symbols in (1, 2):
        chosen = [k for k, w in enumerate(wide) if w == (symbols == 2)]
        for at in range(0, len(chosen), LANES):
            part = chosen[at : at + LANES]
            for k, body in zip(part, _encode([blocks[k] for k in part], symbols)):
                found[k] = body
    return found


def _encode(blocks: list[np.ndarray], symbols: int) -> list[bytes]:
    lengths = np.array([symbols * len(b) for b in blocks], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    longest, lanes = int(lengths.max(initial=0)), len(blocks)
    ids = np.zeros((longest + 2, lanes), np.int32)  # two zeros in front; a symbol has 16 bits
    for lane, k in enumerate(order):
        if symbols == 1:
            ids[2 : 2 + lengths[lane], lane] = blocks[k]
        else:
            ids[2 : 2 + lengths[lane] : 2, lane], ids[3 : 2 + lengths[lane] : 2, lane] = blocks[k] >> 16, blocks[k] & 0xFFFF
    models = _Models(lanes)
    size = 2 * longest + 8
    words, place, line = np.zeros(lanes * size, np.uint32), np.zeros(lanes, np.int64), np.arange(lanes) * size
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    word, sixteen, rest = np.uint64(32), np.uint64(16), np.uint64(2**32 - 1)

    def emit(at: np.ndarray) -> None:
        words[line[at] + place[at]] = (low[at] >> word).astype(np.uint32)  # a carry is in bit 16
        place[at] += 1
        low[at] = (low[at] & rest) << sixteen
        span[at] <<= sixteen

    live = _live(lengths, longest)
    for begin, end in _epochs(longest):
        n = int(live[begin])
        slim = ids[begin + 2 : end + 2, :n]
        now, known = slim.astype(np.int64), ids[begin : end + 1, :n].astype(np.int64)
        at = models.at(known[:-1], known[1:])
        guesses = np.empty(at.shape, np.int32)
        for j in range(end - begin):
            guess = models.tables.take(at[j], out=guesses[j])
            models.tables[at[j]] = models.corrected(guess, slim[j])
        two, one = guesses[:, 0], guesses[:, 1]
        state = models.state(two, one)
        past = two >> 2 != slim
        miss = past & (one >> 2 != slim)
        event = past.astype(np.int64) + miss
        lane = models.lane[:n]
        first, second = models.two_width.take(lane * STATES + state), models.one_width.take(lane * STATES + state)
        start = (past * first + miss * second).astype(np.uint64)
        width = (first + past * (second - first)).astype(np.uint64)
        bins = _BIN_OF.take(now)
        at_bin = lane * (BINS + 1) + bins
        upto = models.upto.take(at_bin)
        each = (models.upto.take(at_bin + 1) - upto) // _WIDTHS.take(bins)
        upto = (miss * (upto + (now - _EDGES.take(bins)) * each)).astype(np.uint64)
        miss, each = miss.astype(np.uint64), each.astype(np.uint64)
        for j in range(end - begin):
            n = int(live[begin + j])
            missed, range_ = miss[j, :n], span[:n]
            share = range_ >> np.uint64(MIX_BITS)
            skip = start[j, :n] * share
            left = width[j, :n] * share
            left += missed * (range_ - skip - left)
            fine = left >> np.uint64(ID_BITS)
            low[:n] += skip + upto[j, :n] * fine
            span[:n] = left + missed * (each[j, :n] * fine - left)
            small = np.flatnonzero(span[:n] < LEAST)
            while len(small):
                emit(small)
                small = small[span[small] < LEAST]
        models.learn(state, event, bins)
    for _ in range(3):
        emit(np.arange(lanes))
    words = words.reshape(lanes, size)
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    found: list[bytes] = [b""] * lanes
    for lane, k in enumerate(order):
        body = HEADER.pack(MAGIC, symbols, len(blocks[k]), place[lane]) + words[lane, : place[lane]].astype("<u2").tobytes()
        found[k] = body + struct.pack("<I", zlib.crc32(body))
    return found


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block whose checksum or form is wrong raises ValueError."""
    heads = []
    for block in coded:
        if len(block) < HEADER.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("the checksum of a block is wrong")
        heads.append(HEADER.unpack_from(block))
        if heads[-1][0] != MAGIC or len(block) != HEADER.size + 4 + 2 * heads[-1][3]:
            raise ValueError("this is not a block of token ids")
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for symbols in (1, 2):
        chosen = [k for k, h in enumerate(heads) if h[1] == symbols]
        for at in range(0, len(chosen), LANES):
            part = chosen[at : at + LANES]
            for k, ids in zip(part, _decode([coded[k] for k in part], [heads[k] for k in part], symbols)):
                found[k] = ids
    return found


def _decode(coded: list[bytes], heads: list[tuple], symbols: int) -> list[np.ndarray]:
    lengths = np.array([symbols * h[2] for h in heads], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    longest, lanes = int(lengths.max(initial=0)), len(coded)
    size = max(h[3] for h in heads) + 3
    words, line = np.zeros((lanes, size), np.uint16), np.arange(lanes) * size
    for lane, k in enumerate(order):
        words[lane, : heads[k][3]] = np.frombuffer(coded[k], "<u2", heads[k][3], HEADER.size)
    models, words = _Models(lanes, lookup=True), words.ravel()
    code = sum(words[line + k].astype(np.uint64) << np.uint64(32 - 16 * k) for k in range(3))
    place, span = line + 3, np.full(lanes, FULL)
    ids = np.zeros((longest + 2, lanes), np.int32)
    live = _live(lengths, longest)
    sixteen = np.uint64(16)
    for begin, end in _epochs(longest):
        n = int(live[begin])
        lane = models.lane[:n]
        at_state, at_bin = lane * STATES, lane * (BINS + 1)
        states, events = np.zeros((end - begin, n), np.int64), np.zeros((end - begin, n), np.int64)
        for j in range(end - begin):
            step = begin + j
            n = int(live[step])
            at = models.at(ids[step, :n].astype(np.int64), ids[step + 1, :n].astype(np.int64))
            guess = models.tables.take(at)
            two, one = guess[0], guess[1]
            state = models.state(two, one)
            key = at_state[:n] + state
            share = span[:n] >> np.uint64(MIX_BITS)
            first, second = models.two_width.take(key) * share, models.one_width.take(key) * share
            value, both = code[:n], first + second
            past, missed = value >= first, value >= both
            event = past.astype(np.int64) + missed
            late = np.flatnonzero(missed)
            code[:n] = value - past * first - missed * second
            span[:n] = first + past * (second - first) + missed * (span[:n] - both - second)
            now = (two + past * (one - two)) >> 2
            fine = span[late] >> np.uint64(ID_BITS)
            value = np.minimum(code[late] // fine, np.uint64(2**ID_BITS - 1)).astype(np.int64)
            here = at_bin[late] + models.first.take((late << CELL_BITS) + (value >> (ID_BITS - CELL_BITS)))
            on = np.flatnonzero(models.upto.take(here + 1) <= value)
            while len(on):
                here[on] += 1
                on = on[models.upto.take(here[on] + 1) <= value[on]]
            from_, bins = models.upto.take(here), here - at_bin[late]
            each = (models.upto.take(here + 1) - from_) // _WIDTHS.take(bins)
            inside = (value - from_) // each
            now[late] = _EDGES.take(bins) + inside
            code[late] -= (from_ + inside * each).astype(np.uint64) * fine
            span[late] = each.astype(np.uint64) * fine
            small = np.flatnonzero(span[:n] < LEAST)
            while len(small):
                code[small] = (code[small] << sixteen) | words[place[small]]
                place[small] += 1
                span[small] <<= sixteen
                small = small[span[small] < LEAST]
            models.tables[at] = models.corrected(guess, now)
            ids[step + 2, :n], states[j, :n], events[j, :n] = now, state, event
        n = int(live[begin])
        models.learn(states, events, _BIN_OF[np.minimum(ids[begin + 2 : end + 2, :n], 65535)])
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, k in enumerate(order):
        row = ids[2 : 2 + lengths[lane], lane].astype(np.uint32)
        found[k] = row if symbols == 1 else (row[::2] << np.uint32(16)) | row[1::2]
    return found
