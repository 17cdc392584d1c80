"""Tables kept as Arrow IPC streams: read in tasks, batch by batch, without running anything that a file holds.

A cache may wrap its stream in a pickle. Its operations are then only listed, never carried out: the one byte string among them
is the stream, and a cache with none or several is refused.
"""

from __future__ import annotations

import io
import pickletools
import tempfile
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()


def shipped(spark: SparkSession) -> None:
    """Sends the package to the executors once per context; only sources that executors import need it."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "ridgeline_sources.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted((root / "ridgeline").rglob("*.py")):
            if "llm" not in path.parts:
                bundle.write(path, str(path.relative_to(root)))
    context.addPyFile(str(target))
    _SHIPPED.add(context)


def payload(content: bytes, pickled: bool) -> bytes:
    """The IPC stream of a file's content."""
    if not pickled:
        return content
    found = [value for operation, value, _ in pickletools.genops(content) if operation.name in ("BINBYTES", "BINBYTES8", "SHORT_BINBYTES")]
    if len(found) != 1:
        raise ValueError(f"expected one byte string in the cache, found {len(found)}")
    return found[0]


def decoded(frame: DataFrame, column: str, schema: StructType | str, pickled: bool = False) -> DataFrame:
    """The rows of all streams in a binary column; a column that a stream lacks, or has in another type, stops the job."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = to_arrow_schema(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                if content.as_py() is None:
                    continue
                with pa.ipc.open_stream(io.BytesIO(payload(content.as_py(), pickled))) as stream:
                    for batch in stream:
                        columns = [batch.column(batch.schema.get_field_index(f.name)) if batch.schema.get_field_index(f.name) >= 0 else _lacks(f.name) for f in wanted]
                        yield pa.RecordBatch.from_arrays([_cast(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    return frame.select(column).mapInArrow(run, kind)


def _lacks(name: str):
    raise ValueError(f"the stream has no column {name}")


def _cast(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """column as kind where no value changes: dates and times by unit, wider numbers, larger strings."""
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and (kind.tz is None) != (column.type.tz is None):
        raise ValueError(f"{column.type} is no {kind}")
    return column.cast(kind)


def encoded(frame: DataFrame) -> DataFrame:
    """One IPC stream per batch of a partition: rows (stream, rows). decoded is its inverse."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary()), pa.array([part.num_rows], pa.int64())], ["stream", "rows"])

    return frame.mapInArrow(run, "stream binary, rows long")


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path with their content, one row each; a file is read by one task."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.load(path).select("path", "content")


def stream_schema(files: DataFrame, pickled: bool = False) -> StructType:
    """The schema of the first file's stream. A task reads the file; the driver gets the stream's header alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                with pa.ipc.open_stream(io.BytesIO(payload(content.as_py(), pickled))) as stream:
                    yield pa.RecordBatch.from_pydict({"head": [stream.schema.serialize().to_pybytes()]})

    head = files.orderBy("path").limit(1).select("content").mapInArrow(run, "head binary").first()
    if head is None:
        raise FileNotFoundError("no stream")
    return from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(head["head"]))), prefer_timestamp_ntz=True)


def arrow_cache(spark: SparkSession, path: str, schema: StructType | str | None = None, pickled: bool = False, glob: str = "*") -> DataFrame:
    """The rows of all Arrow streams under a path. The schema is that of the first file unless it is given."""
    files = stream_files(spark, path, glob)
    return decoded(files, "content", schema or stream_schema(files, pickled), pickled)


def membership(frame: DataFrame) -> DataFrame:
    """Membership lists (vt_symbol, spans array<struct<start,end>>) as interval rows; ValueError at read for a span that ends before it starts."""
    rows = frame.select("vt_symbol", F.inline("spans"))
    sound = F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("no interval of "), "vt_symbol")).cast("date"))
    return rows.select("vt_symbol", sound.alias("member_start"), F.col("end").alias("member_end"))
