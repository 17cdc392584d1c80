"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bounds of ranges that a plan spells out, and ranges that a corpus is cut into, at most.
LITERALS, MOST_RANGES = 512, 1 << 16

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per Spark context, so that Python tasks can import it."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "ridgeline_src.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted((root / "ridgeline").rglob("*.py")):
            bundle.write(path, str(path.relative_to(root)))
    context.addPyFile(str(target))
    _SHIPPED.add(context)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a temporary folder; a cluster has to name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def keep(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint of frame: later steps start from it, and a lost executor loses none of it.

    The shuffle files of the steps before it are no longer needed and go as soon as nothing else refers to them.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    kept = frame.checkpoint()
    del frame
    release(spark)
    return kept


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which stay until the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def streamed(frame: DataFrame, keys: list[str], compute, schema: str) -> DataFrame:
    """compute(group: dict of arrays) -> dict of arrays or None, over the rows of each value of the integer columns keys.

    Rows are partitioned and sorted by keys and groups cut from the stream of batches, so a task holds one
    group at a time and small groups cost no frame of their own.
    """
    names = frame.columns
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key_of = None
        outs: list[dict] = []

        def close():
            if held:
                whole = pa.Table.from_batches(held)
                out = compute({n: whole.column(n) for n in names})
                held.clear()
                if out is not None:
                    outs.append(out)

        def flush():
            if outs:
                columns = [np.concatenate([np.asarray(o[f.name]) for o in outs]) for f in types]
                outs.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        for part in parts:
            if part.num_rows == 0:
                continue
            values = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(part.num_rows, bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change), part.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(v[a] for v in values)
                if now != key_of:
                    close()
                    key_of = now
                held.append(part.slice(a, b - a))
            yield from flush()
        close()
        yield from flush()

    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quantiles(frame: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending values that cut column into ranges of about equal row counts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = frame.select(F.percentile_approx(column, shares, F.lit(20 * parts)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(column: Column, bounds: list) -> Column:
    """The number of bounds that are <= column; nulls go to 0.

    Up to LITERALS bounds are a balanced tree of comparisons; more are searched in Arrow batches and go to the tasks as data, so that
    no plan grows with the corpus.
    """
    if len(bounds) > LITERALS:
        table = np.array(bounds, np.int64)

        @F.pandas_udf("int")
        def search(values: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(table, values.to_numpy(), side="right").astype(np.int32))

        return F.when(column.isNull(), 0).otherwise(search(F.coalesce(column, F.lit(0)).cast("long")))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(bounds[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))


def by_ranges(docs: DataFrame, name: str, tie: Column, most: int, least: int, text: str = "text") -> tuple[list, DataFrame]:
    """docs with the column `name`: the number of a row's range, ascending with (doc_id nulls first, tie), tie being a hash.

    Ranges hold about `most` bytes of text, or down to `least` if the session has more partitions; where that were over MOST_RANGES,
    they hold more, as a task streams its range and keeps none of it. Rows without an id are
    dealt to as many ranges as the others, by their hash, so that they may be any share of the rows. The second
    result has at most twice as many ranges as the first result has bounds, and two.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // most), min(partitions(docs.sparkSession), -(-size // least)))
    bounds = quantiles(docs, "doc_id", min(parts, MOST_RANGES))
    return bounds, docs.withColumn(name, range_number(bounds, tie))


def range_number(bounds: list, tie: Column) -> Column:
    """The number of a row's range as in by_ranges."""
    count = len(bounds) + 1
    of_null = F.floor((F.shiftright(tie, 32) + F.lit(2**31)) * count / F.lit(2**32))
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(count + range_of(F.col("doc_id"), bounds)).cast("int")


def running(frame: DataFrame, groups: list[str], bucket: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over the rows before this one in its group.

    Rows of a group are ordered by bucket, then by order. A group may hold any share of the rows: each
    (group, bucket) is summed first, and only the bucket totals of a group pass through one window.
    """
    values = {f"__v_{name}": column for name, column in sums.items()}
    frame = frame.withColumns(values)
    totals = frame.groupBy(*groups, bucket).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups],
        F.col(bucket).alias("__g_bucket"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v.replace("__v_", "__o_")) for v in values],
    )
    same = [frame[g].eqNullSafe(offsets[f"__g_{g}"]) for g in groups] + [frame[bucket] == offsets["__g_bucket"]]
    within = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = frame.join(offsets, reduce(lambda a, b: a & b, same))
    added = {
        name: F.col(f"__o_{name}") + F.coalesce(F.sum(f"__v_{name}").over(within), F.lit(0)) for name in sums
    }
    return joined.withColumns(added).drop(*values, *offsets.columns)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), component being the smallest node.

    Alternating large-star and small-star contraction; every round is two aggregations with map-side
    combine and two joins, and starts from a checkpoint. Nodes without an edge do not appear.
    """
    pairs = keep(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    )

    def star(linked: DataFrame) -> DataFrame:
        lowest = linked.groupBy("u").agg(F.min("v").alias("m"))
        return linked.join(lowest, "u")

    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("c"))
        large = large.where("u > c").select("u", "v").where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        pairs = keep(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
