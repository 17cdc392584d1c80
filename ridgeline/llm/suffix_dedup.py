"""Removal of repeated passages: every byte that a 50-byte string covers which also starts in a lower document.

Any 50 bytes hold 33 windows of 18 bytes; the first of those with the least hash is the seed of the 50 bytes. A text
is so cut into snippets: the strings of 50 bytes in a row that have one seed, 66 bytes on average. Equal strings of
50 bytes have equal seeds at equal places, so only snippets whose seed lies in several documents can be part of a
repeated passage. A run-length index (run_index) answers which strings of a snippet lower documents have, and holds
each different snippet of a seed once, as a row of its lowest document:

- Equal snippets are the tail of one run of such an index, behind the sample at its head: whatever the index holds, all
  their strings are the head's too. They are told by 112 bits (two hashes in different bases, 48 of the seed's and 64 of
  the snippet's) and settled when runs are formed, inside a task before anything is shuffled and once more by seed. So a
  passage that thousands of documents hold crosses the network once for each task, and its text once.
- Two different snippets that share 50 bytes agree in the 16 bytes before their seed or in the 16 bytes after it. A
  snippet that agrees with no other of its seed in either has no match and stays out of the index.
- All others go to the index of their seed's shard: a run-compressed Burrows-Wheeler transform with sampled run heads.
  They are streamed through it, and matches of 50 bytes with a lower document are marked.
- A seed with more than `hot` different snippets that agree on one side (at the border of a very common passage) is not
  sent to one index: all its snippets, whichever side they agree on, are taken apart into their 50-byte strings, which
  go to the indexes by content, equal ones of a task as one.

Shuffled rows hold arrays of many seeds or spans. Documents are met with their spans by one shuffle.

Cases: null texts count as empty; texts under 50 bytes lose nothing; strings are judged on the input, and
matches within one document do not count; rows that share a doc_id are one document as to who is lower, each
cut by its own text; rows with a null doc_id are kept whole; an empty table gives an empty result; added columns
replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import keep
from ridgeline.llm.hashing import BASES, Ranges, slices, text_bytes
from ridgeline.llm.run_index import CLOSE, RunIndex

WIDTH = 50
SEED = 18
HOT = 16_384
#: Text for each bucket of seeds: what a task sorts at once grows with it, the number of packed rows falls.
BUCKET_BYTES = 4_000_000
#: Snippets that a task holds before it forms runs and packs them, and bytes of snippets or strings.
HELD, HELD_BYTES = 400_000, 8_000_000
PACKED = "target int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
COLUMNS = "abcdef"
SCHEMA = pa.schema([("target", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in COLUMNS]])
CLASSES, SPANS, REQUESTS, PIECES = range(4)
#: A place in a text is packed with bits of the text's checksum above it, so that texts of one doc_id stay apart.
PLACE_BITS = 40


def prime_above(n: int) -> int:
    """So that ids at any regular distance spread evenly over that many targets."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which Spark's shuffle compression then shortens."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(blob, np.uint8).reshape(size, len(blob) // size).T.copy().view(dtype).ravel()


def _rows(kind: int, target: np.ndarray, columns: list[np.ndarray], texts: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch | None:
    """One packed row for each target; texts: bytes in a row and how many each item has, the last column."""
    if len(target) == 0:
        return None
    order = np.argsort(target, kind="stable")
    target, columns = target[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(target)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(target)]])
    blobs = [[_pack(c[s:e]) for s, e in zip(starts, ends)] for c in columns]
    if texts is not None:
        raw, size = texts
        raw, at = _gathered(raw, (np.cumsum(size) - size)[order], size[order])
        blobs.append([raw[at[s] : at[e]].tobytes() for s, e in zip(starts, ends)])
    blobs += [[None] * len(starts)] * (len(COLUMNS) - len(blobs))
    return pa.RecordBatch.from_arrays(
        [pa.array(target[starts], pa.int32()), pa.array(np.full(len(starts), kind, np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], schema=SCHEMA
    )


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges of raw in a row, and where each begins and the last one ends."""
    at = np.concatenate([[0], np.cumsum(size)])
    return raw[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def _tags(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, bits of its checksum at the place above PLACE_BITS."""
    view = memoryview(raw)
    return np.array([(zlib.crc32(view[a:b]) & 0x7FFF) << PLACE_BITS for a, b in zip(at.tolist(), at[1:].tolist())], np.int64)


def snippets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH, seed: int = SEED):
    """The snippets of all texts: (seed's place in raw, snippet's start, its end, hash of the seed)."""
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none.astype(np.uint64)
    hashes = Ranges(raw).windows(seed)
    # The least hash of the seed windows of each string, and of equal ones the first.
    low = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    reach, span = width - seed, 1
    strings = len(raw) - width + 1
    while span * 2 <= reach + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:strings], low[reach + 1 - span :][:strings])
    place = (low & np.uint64(2**32 - 1)).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int8)  # of strings that end in their text
    whole = np.diff(at) >= width
    inside[at[:-1][whole]] += 1
    inside[at[1:][whole] - width + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8)[:strings])
    place = place[start]
    fresh = np.flatnonzero(_first_of(place)) if len(place) else none
    last = np.append(fresh[1:], len(place)) - 1
    return place[fresh], start[fresh], start[last] + width if len(last) else none, hashes[place[fresh]]


def identities(raw: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each snippet 64 bits for all of it, and 24 for its sides: 12 for the bytes before the seed, 12 for those after.

    The sides have the half of (width - seed) bytes that any common string has on one of them at least; a side that is
    shorter has bits of its own.
    """
    half = (width - seed + 1) // 2
    ranges = Ranges(raw, BASES[1])
    whole = ranges.of(start, end) ^ ((place - start) * 64 + end - place).astype(np.uint64)
    before = np.where(place - start >= half, ranges.of(np.maximum(place - half, 0), place), whole)
    after = np.where(end - place - seed >= half, ranges.of(place + seed, np.minimum(place + seed + half, len(raw))), whole)
    return whole, ((before >> np.uint64(52) << np.uint64(12)) | (after >> np.uint64(52))).astype(np.uint32)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of a document that overlap or touch become one; sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc) == 0:
        return doc, start, end
    tag = start >> PLACE_BITS
    shift = np.cumsum(_first_of(doc, tag)) - 1
    shift = shift * (int((end - (tag << PLACE_BITS)).max()) + 1) - (tag << PLACE_BITS)  # texts behind one another
    upto = np.maximum.accumulate(end + shift)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (start[1:] + shift[1:]) > upto[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], start[first], (upto - shift)[np.append(first[1:], len(doc)) - 1]


def _spans(doc, start, end, targets: int) -> pa.RecordBatch | None:
    doc, start, end = _merged(doc, start, end)
    return _rows(SPANS, np.mod(doc, targets), [doc, start, (end - start).astype(np.int64)])


def _first_of(*columns: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _run_heads(columns: list[np.ndarray], targets: int):
    """Of snippets (hash, whole, sides, doc, start, length), sorted: those of the lowest document of each run, and spans of the others."""
    order = np.lexsort((columns[3], columns[1], columns[0]))
    hashes, whole, sides, doc, start, length = (c[order] for c in columns)
    fresh = np.flatnonzero(_first_of(hashes, whole))
    lowest = np.repeat(doc[fresh], np.diff(np.append(fresh, len(doc))))
    later = doc > lowest
    spans = _spans(doc[later], start[later], (start + length.astype(np.int64))[later], targets)
    first = np.zeros(len(doc), bool)
    first[fresh] = True
    return [c[~later] for c in (hashes, whole, sides, doc, start, length)], first[~later], spans


_CLASS_TYPES = (np.uint64, np.uint64, np.uint32, np.int64, np.int64, np.uint16)


def _classes(buckets: int, targets: int, width: int, seed: int):
    """From texts: the lowest document of each run of equal snippets, and spans of the other ones of this task."""

    def settle(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns, _, spans = _run_heads([np.concatenate(c) for c in zip(*found)], targets)
        found.clear()
        if spans is not None:
            yield spans
        order = np.argsort(columns[3], kind="stable")
        columns = [c[order] for c in columns]
        if (rows := _rows(CLASSES, (columns[0] % np.uint64(buckets)).astype(np.int32), columns)) is not None:
            yield rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for part in (piece for whole in parts for piece in slices(whole)):
            raw, at = text_bytes(part.column("text"))
            place, start, end, hashes = snippets(raw, at, width, seed)
            if len(place) == 0:
                continue
            text = np.searchsorted(at, place, side="right") - 1
            own = start - at[text] + _tags(raw, at)[text]
            # Of the seed's hash 48 bits travel: planes of zeros cost nothing.
            found.append((hashes >> np.uint64(16), *identities(raw, place, start, end, width, seed), part.column("doc_id").to_numpy()[text], own, (end - start).astype(np.uint16)))
            held += len(place)
            if held >= HELD:
                yield from settle(found)
                held = 0
        if found:
            yield from settle(found)

    return run


def _shared(targets: int, hot: int):
    """From the runs of a bucket: spans of documents that are not the lowest of their run, requests for text."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns, first, spans = _run_heads([np.concatenate(c) for c in zip(*rows)], targets)
        if spans is not None:
            yield spans
        hashes, _, sides, doc, start, length = columns
        wanted, lower, many = (np.zeros(len(doc), bool) for _ in range(3))
        for side in (sides >> np.uint32(12), sides & np.uint32(0xFFF)):
            order = np.lexsort((side, hashes))
            group = np.flatnonzero(_first_of(hashes[order], side[order]))
            sizes = np.diff(np.append(group, len(doc)))
            runs = np.add.reduceat(first[order].astype(np.int64), group)
            bottom, top = np.minimum.reduceat(doc[order], group), np.maximum.reduceat(doc[order], group)
            shared = np.repeat((runs > 1) & (bottom < top), sizes)
            wanted[order] |= shared
            lower[order] |= shared & (doc[order] > np.repeat(bottom, sizes))
            many[order] |= shared & np.repeat(runs > hot, sizes)
        # All snippets of a seed have to meet, so one of its groups decides for the whole of it.
        of_seed = np.flatnonzero(_first_of(hashes))
        many = np.repeat(np.logical_or.reduceat(many, of_seed), np.diff(np.append(of_seed, len(hashes))))
        flags = (2 * many + ~lower)[wanted].astype(np.uint8)
        hashes, doc, start, length = (c[wanted] for c in (hashes, doc, start, length))
        if (packed := _rows(REQUESTS, np.mod(doc, targets), [doc, start, length, hashes, flags])) is not None:
            yield packed

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for part in parts:
            passed = part.filter(pa.compute.equal(part.column("kind"), SPANS))
            if passed.num_rows:
                yield passed
            part = part.filter(pa.compute.equal(part.column("kind"), CLASSES))
            blobs = [part.column(c).to_pylist() for c in COLUMNS]
            for target, *row in zip(part.column("target").to_pylist(), *blobs):
                if target != bucket and held:
                    yield from settle(held)
                    held = []
                bucket = target
                held.append(tuple(_unpack(b, t) for b, t in zip(row, _CLASS_TYPES)))
        if held:
            yield from settle(held)

    return run


def _met(documents: DataFrame, packed: DataFrame, targets: int, kind: int, run, schema: str) -> DataFrame:
    """run over batches (target, kind, doc_id, text, a .. f): in each target first packed rows, then documents."""
    nowhere = F.pmod(F.xxhash64("text"), F.lit(targets))  # documents without an id meet nothing
    docs = documents.withColumn("target", F.coalesce(F.pmod("doc_id", F.lit(targets)), nowhere).cast("int")).withColumn("kind", F.lit(9))
    both = packed.where(F.col("kind") == kind).unionByName(docs, allowMissingColumns=True)
    columns = ["target", "kind", "doc_id", "text", *COLUMNS]
    return both.select(columns).repartition("target").sortWithinPartitions("target", "kind").mapInArrow(run, schema)


def _by_target(parts: Iterator[pa.RecordBatch], types: tuple):
    """For each batch of documents of one target: (arrays of all packed rows of the target sorted by document, the batch)."""
    held, target, arrays = [], None, None

    def together():
        if not held:
            return None
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    for part in parts:
        targets, kinds = part.column("target").to_numpy(), part.column("kind").to_numpy()
        cut = np.flatnonzero((np.diff(targets) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cut], [*cut, part.num_rows]):
            if a == b:
                continue
            if targets[a] != target:
                target, held, arrays = targets[a], [], None
            piece = part.slice(a, b - a)
            if kinds[a] != 9:
                blobs = [piece.column(c).to_pylist() for c in COLUMNS[: len(types)]]
                held += [tuple(_unpack(x, t) for x, t in zip(row, types)) for row in zip(*blobs)]
                arrays = None
                continue
            if arrays is None and held:
                arrays, held = together(), []
            for some in slices(piece):
                yield arrays, some


def _strings(raw: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of width bytes of the snippets in raw: (snippet, place in it, hash)."""
    count = size - width + 1
    of = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, place, Ranges(raw).windows(width)[(np.cumsum(size) - size)[of] + place]


def _pieces(shards: int, targets: int, width: int):
    """From requests and texts: the snippets, to the index shard of their seed; of hot seeds, strings by content."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, start, size, hashes, flags = (np.concatenate([h[k] for h in held]) for k in range(5))
        raw = np.concatenate([h[5] for h in held])
        held.clear()
        at = np.cumsum(size) - size
        cold = flags < 2
        texts = _gathered(raw, at[cold], size[cold])[0]
        shard = (hashes[cold] % np.uint64(shards)).astype(np.int32)
        rows = _rows(PIECES, shard, [docs[cold], start[cold], flags[cold], size[cold].astype(np.uint16)], (texts, size[cold]))
        if rows is not None:
            yield rows
        if cold.all():
            return
        docs, start, size = docs[~cold], start[~cold], size[~cold]
        texts, at = _gathered(raw, at[~cold], size)
        of, place, hashes = _strings(texts, size, width)
        # Of equal strings held, the lowest document's go on; the others are marked here.
        other = Ranges(texts, BASES[1]).windows(width)[at[of] + place]
        order = np.lexsort((docs[of], other, hashes))
        of, place, hashes, other = (c[order] for c in (of, place, hashes, other))
        fresh = np.flatnonzero(_first_of(hashes, other))
        later = docs[of] > np.repeat(docs[of[fresh]], np.diff(np.append(fresh, len(of))))
        begin = start[of] + place
        spans = _spans(docs[of[later]], begin[later], begin[later] + width, targets)
        if spans is not None:
            yield spans
        of, place, hashes, begin = (c[~later] for c in (of, place, hashes, begin))
        long = np.full(len(of), width)
        strings = _gathered(texts, at[of] + place, long)[0]
        yield _rows(PIECES, (hashes % np.uint64(shards)).astype(np.int32), [docs[of], begin, np.zeros(len(of), np.uint8), long.astype(np.uint16)], (strings, long))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for asked, part in _by_target(parts, (np.int64, np.int64, np.uint16, np.uint64, np.uint8)):
            if asked is None:
                continue
            raw, at = text_bytes(part.column("text"))
            ids = part.column("doc_id").to_numpy()
            a, b = np.searchsorted(asked[0], ids), np.searchsorted(asked[0], ids, side="right")
            request = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
            text = np.repeat(np.arange(len(ids)), b - a)
            fits = (asked[1][request] >> PLACE_BITS << PLACE_BITS) == _tags(raw, at)[text]  # else another text of this doc_id
            request, text = request[fits], text[fits]
            docs, start, length, hashes, flags = (c[request] for c in asked)
            length = length.astype(np.int64)
            held.append((docs, start, length, hashes, flags, _gathered(raw, at[text] + (start & (2**PLACE_BITS - 1)), length)[0]))
            # A string of a hot snippet is sent on its own.
            size += int(np.where(flags < 2, length, (length - width + 1) * width).sum())
            if size > HELD_BYTES:
                yield from flush(held)
                size = 0
        if held:
            yield from flush(held)

    return run


def _indexed(targets: int, width: int):
    """From the pieces of index shards: spans of matches with lower documents."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, start, flag, size = (np.concatenate([_unpack(r[k], t) for r in rows]) for k, t in enumerate((np.int64, np.int64, np.uint8, np.uint16)))
        raw, size = np.frombuffer(b"".join(r[4] for r in rows), np.uint8), size.astype(np.int64)
        order = np.argsort(doc, kind="stable")
        at = (np.cumsum(size) - size)[order]
        doc, start, flag, size = (c[order] for c in (doc, start, flag, size))
        text = np.full(int(size.sum()) + len(size), CLOSE, np.uint8)
        places = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        text[places] = _gathered(raw, at, size)[0]
        string, place = RunIndex(text, size, doc, width).lower_matches(np.flatnonzero(flag == 0))
        spans = _spans(doc[string], start[string] + place, start[string] + place + width, targets)
        if spans is not None:
            yield spans

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for part in parts:
            for target, *row in zip(part.column("target").to_pylist(), *(part.column(c).to_pylist() for c in COLUMNS)):
                if target != shard and held:
                    yield from settle(held)
                    held = []
                shard = target
                held.append(row)
        if held:
            yield from settle(held)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,length:long>>"


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for spans, part in _by_target(parts, (np.int64, np.int64, np.int64)):
        raw, at = text_bytes(part.column("text"))
        tags, rows = _tags(raw, at), []
        for k, doc in enumerate(part.column("doc_id").to_pylist()):
            text = raw[at[k] : at[k + 1]]
            starts = lengths = np.zeros(0, np.int64)
            if spans is not None and doc is not None:
                a, b = np.searchsorted(spans[0], [doc, doc + 1])
                begin, size = spans[1][a:b] - tags[k], spans[2][a:b]
                own = begin >> PLACE_BITS == 0
                _, starts, ends = _merged(spans[0][a:b][own], begin[own], (begin + size)[own])
                lengths = ends - starts
            gone = np.zeros(len(text) + 1, np.int8)
            gone[starts] += 1
            gone[starts + lengths] -= 1
            left = text[np.cumsum(gone[:-1]) == 0].tobytes() if len(starts) else text.tobytes()
            pieces = [{"start": s, "length": n} for s, n in zip(starts.tolist(), lengths.tolist())]
            rows.append((doc, len(text), len(text) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left, pieces))
        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), struct]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def remove_repeats(documents: DataFrame, width: int = WIDTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans), one per row of documents.

    kept has the bytes that stay, spans the removed runs.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where("doc_id IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-size // BUCKET_BYTES))
    targets = prime_above(buckets)
    classes = known.where("text IS NOT NULL").mapInArrow(_classes(buckets, targets, width, seed), PACKED)
    dealt = classes.repartition("target").sortWithinPartitions("target")
    first = keep(dealt.mapInArrow(_shared(targets, hot), PACKED))
    del dealt, classes
    pieces = keep(_met(known, first, targets, REQUESTS, _pieces(4 * buckets, targets, width), PACKED))
    second = pieces.where(F.col("kind") == PIECES).repartition("target").sortWithinPartitions("target")
    second = keep(second.mapInArrow(_indexed(targets, width), PACKED))
    spans = first.unionByName(pieces).unionByName(second)
    return _met(docs, spans, targets, SPANS, _cut, RESULT)
