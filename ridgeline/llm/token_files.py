"""Token-id files: documents are tokenised, and their ids written as range-coded blocks in doc_id order.

A file set is a Parquet data set of blocks (any store that Spark writes can hold it). Blocks are numbered by
range of doc_id and place in the range; ranges have about equal numbers of documents, and their number follows the
amount of text. Each block has the ids of a run of documents, a document that does not fit going on in the next block. The ids are coded by range_coder, whose blocks are reset and checksummed on their
own, so a lost or damaged block harms no other and any block can be read alone.

Cases: null and empty texts hold the end id only; rows that share a doc_id are separate documents in order of
a hash of the text, then the text; null ids come first, dealt to ranges of their own by that hash; very long texts
span many blocks; repeated rows are separate documents; an empty table gives an empty file set; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import range_coder
from ridgeline.llm.common import by_ranges, keep, running
from ridgeline.llm.hashing import slices
from ridgeline.llm.tokens import encoder, with_end

TOKENIZER = "word_bpe_49k.json"
END = 2
BLOCK_FIELDS = "part int, number long, ordinals array<long>, doc_ids array<long>, places array<long>, lengths array<long>, closed array<boolean>, coded binary"
#: Text of one range of documents, which one task encodes: at most, and at least where the cluster has more cores.
PART_BYTES, LEAST_PART_BYTES = 32_000_000, 4_000_000
#: Text that is tokenised at once.
SLICE_BYTES = 4_000_000
#: Blocks that are decoded at once.
DECODED = 768


_ID = pa.int64()
_BLOCKS = pa.schema([("part", pa.int32()), ("number", _ID), *[(c, pa.list_(_ID)) for c in ("ordinals", "doc_ids", "places", "lengths")],
                     ("closed", pa.list_(pa.bool_())), ("coded", pa.binary())])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind, from_pandas=True), type=pa.list_(kind))


class _Part:
    """The ids of one range of documents that are not written yet, and which documents they are of."""

    def __init__(self, part: int):
        self.part, self.written, self.held, self.documents = part, 0, 0, 0
        self.ids: list[np.ndarray] = []
        # Of each document that has ids here: its id, whether it has one, its number in the part, where it starts and ends there.
        self.docs = [np.zeros(0, np.int64)] * 5

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        start = self.written + self.held + at
        fresh = (doc_ids, known.astype(np.int64), self.documents + np.arange(len(doc_ids)), start[:-1], start[1:])
        self.docs = [np.concatenate([d, f]) for d, f in zip(self.docs, fresh)]
        self.ids.append(ids)
        self.held += len(ids)
        self.documents += len(doc_ids)

    def blocks(self, last: bool) -> pa.RecordBatch | None:
        """Whole blocks of the ids held, and what is left if the part ends here."""
        size = range_coder.BLOCK
        count = -(-self.held // size) if last else self.held // size
        if count == 0:
            return None
        ids = np.concatenate(self.ids)
        taken = min(count * size, len(ids))
        begin, end = self.written, self.written + taken
        self.ids, self.held, self.written = [ids[taken:].copy()], len(ids) - taken, end
        doc_ids, known, ordinals, starts, ends = self.docs
        cuts = np.unique(np.concatenate([np.arange(begin, end, size), np.maximum(starts[starts < end], begin)]))
        of = np.searchsorted(starts, cuts, side="right") - 1
        length = np.diff(np.append(cuts, end))
        offsets = np.searchsorted(cuts, np.append(np.arange(begin, end, size), end))
        self.docs = [d[ends > end] for d in self.docs]
        coded = range_coder.encode([ids[i : min(i + size, taken)] for i in range(0, taken, size)])
        id_values = pa.array(doc_ids[of], pa.int64(), mask=known[of] == 0)
        columns = [
            pa.array(np.full(count, self.part, np.int32)), pa.array(np.arange(count) + begin // size),
            _lists(ordinals[of], offsets, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), id_values),
            _lists(cuts - starts[of], offsets, pa.int64()), _lists(length, offsets, pa.int64()), _lists(cuts + length == ends[of], offsets, pa.bool_()),
            pa.array(coded, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)


def _blocks(tokenizer: str, end: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, open_part = encoder(tokenizer), None
        enough = range_coder.LANES * range_coder.BLOCK
        for batch in (piece for whole in parts for piece in slices(whole, limit=SLICE_BYTES)):
            numbers = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                some = batch.slice(a, b - a)
                if open_part is None or open_part.part != numbers[a]:
                    if open_part is not None and (out := open_part.blocks(last=True)) is not None:
                        yield out
                    open_part = _Part(int(numbers[a]))
                doc_id = some.column("doc_id")
                open_part.add(doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), *with_end(*one.encode(some.column("text")), end))
                if open_part.held >= enough and (out := open_part.blocks(last=False)) is not None:
                    yield out
        if open_part is not None and (out := open_part.blocks(last=True)) is not None:
            yield out

    return run


def write(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Writes the ids of all texts, each followed by end, to the file set at path."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounds, docs = by_ranges(docs, "part", F.xxhash64("text"), PART_BYTES, LEAST_PART_BYTES)
    ordered = docs.repartition(2 * len(bounds) + 2, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    ordered.mapInArrow(_blocks(tokenizer, end), BLOCK_FIELDS).write.option("compression", "uncompressed").parquet(path)


PIECES = "part int, ordinal long, doc_id long, place long, length long, closed boolean, ids binary"


_PIECES = pa.schema([("part", pa.int32()), *[(c, _ID) for c in ("ordinal", "doc_id", "place", "length")], ("closed", pa.bool_()), ("ids", pa.binary())])
_CRCS = pa.schema([*list(_PIECES)[:-1], ("crc", _ID)])


def _blobs(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(4 * upto), pa.py_buffer(ids)]).cast(pa.binary())


def _crcs(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    raw, at = memoryview(ids).cast("B"), (4 * upto).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], _ID)


def _decoded(schema: pa.Schema, last: Callable[[np.ndarray, np.ndarray], pa.Array]):
    """last(ids, upto) makes the last column of pieces of the ids and of where the pieces begin and end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, DECODED):
                part = whole.slice(at, DECODED)
                found = range_coder.decode(part.column("coded").to_pylist())
                count = part.column("lengths").value_lengths().to_numpy()
                flat = {c: part.column(c).flatten() for c in ("ordinals", "doc_ids", "places", "lengths", "closed")}
                upto = np.concatenate([[0], np.cumsum(flat["lengths"].to_numpy())]).astype(np.int64)
                ids = np.concatenate([*found, np.zeros(0, np.uint32)]).astype("<u4", copy=False)
                del found
                numbers = pa.array(np.repeat(part.column("part").to_numpy(), count))
                columns = [numbers, *flat.values(), last(ids, upto)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, ordinal, doc_id, place, length, closed, ids) of a file set: pieces of documents with their ids as bytes.

    place is the number of the document's ids before the piece.
    """
    return spark.read.parquet(path).mapInArrow(_decoded(_PIECES, _blobs), PIECES)


def read_crcs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of read with the crc32 of a piece's ids in their place: made where they are decoded, so no ids leave that Python worker."""
    return spark.read.parquet(path).mapInArrow(_decoded(_CRCS, _crcs), PIECES.replace("ids binary", "crc long"))


def _step_tables() -> np.ndarray:
    """Row b: what the crc32 register's 32 bits become after 2 ** b zero bits, by squaring the one-bit step over GF(2)."""
    tables = np.zeros((64, 32), np.uint32)
    tables[0] = [0xEDB88320] + [1 << k for k in range(31)]
    for b in range(1, 64):
        tables[b] = _times(tables[b - 1], tables[b - 1])
    return tables


def _times(table: np.ndarray, registers: np.ndarray) -> np.ndarray:
    out = np.zeros_like(registers)
    for k in range(32):
        out ^= table[k] * ((registers >> np.uint32(k)) & np.uint32(1))
    return out


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The crc32 of strings as it counts in that of a longer string, which goes on for n_bytes bytes after them.

    The crc32 of a string is the exclusive or of these over its parts.
    """
    tables, out, bits = _step_tables(), crc.astype(np.uint32), n_bytes.astype(np.uint64) << np.uint64(3)
    for b in range(int(bits.max(initial=0)).bit_length()):
        some = np.flatnonzero((bits >> np.uint64(b)) & np.uint64(1))
        out[some] = _times(tables[b], out[some])
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the documents of a file set, from its blocks."""

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
        return pd.Series(crc_shifted(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))

    found = keep(read_crcs(spark, path).withColumn("alone", F.col("closed") & (F.col("place") == 0)))
    whole = found.where("alone").select("part", "ordinal", "doc_id", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    split = found.where("NOT alone")
    sizes = split.where("closed").select("part", "ordinal", (F.col("place") + F.col("length")).alias("n_tokens"))
    split = split.join(sizes, ["part", "ordinal"])
    after = 4 * (F.col("n_tokens") - F.col("place") - F.col("length"))
    split = split.withColumn("crc", shifted("crc", after)).groupBy("part", "ordinal", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    counted = running(whole.unionByName(split), [], "part", ["ordinal"], {"start": F.col("n_tokens")})
    return counted.select("doc_id", F.col("start").cast("long"), "n_tokens", "ids_crc32")
