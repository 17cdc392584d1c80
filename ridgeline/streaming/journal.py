"""A keyed journal in buckets: batches are merged by copying only the buckets that they touch.

    path/data/batch=N/bucket=B/...     rows of bucket B as batch N left them
    path/commits/batch=N/...           one row (bucket, at) per bucket: the batch that wrote it last, written when all data of N is there

A reader takes the last commit. A batch that failed on the way has no commit and is not seen; a batch that is run again starts from
the commit before its own and writes the same folders anew, so that it counts once. Every commit lists all buckets, whose number is fixed,
so neither a reader nor a batch looks at more than one. Folders that no commit of interest names can be deleted at any time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 32


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The buckets of the last commit (below `before`), by the batch that wrote each."""
    try:
        found = spark.read.schema("bucket int, at long, batch long").json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found = found if before is None else found.where(F.col("batch") < before)
    last = found.agg(F.max("batch").alias("n")).first()["n"]
    return {} if last is None else {r["bucket"]: r["at"] for r in found.where(F.col("batch") == last).collect()}  # one row per bucket


def _buckets(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/batch={at}/bucket={b}" for b, at in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def journal(spark: SparkSession, path: str, schema, as_of: int | None = None) -> DataFrame:
    """All rows of the journal as its last batch left them, or as the batch `as_of` did."""
    return _buckets(spark, path, _commit(spark, path, None if as_of is None else as_of + 1), schema)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _merged(fresh: DataFrame, old: DataFrame, keys: list[str], when: str, buckets: int) -> DataFrame:
    if when == "refuse":
        both = fresh.select(*keys, F.lit(True).alias("__new")).unionByName(old.select(*keys, F.lit(False).alias("__new")))
        taken = both.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or("__new").alias("new")).where("new AND n > 1").first()
        if taken is not None:
            raise ValueError(f"the journal or the batch has this key already: { {k: taken[k] for k in keys} }")
    if when == "ignore":
        fresh = fresh.join(old.select(*keys).distinct(), _same(fresh, old, keys), "left_anti")
    if when == "replace":
        old = old.join(fresh.select(*keys).distinct(), _same(old, fresh, keys), "left_anti")
    return old.withColumn("bucket", bucket_of(keys, buckets)).unionByName(fresh)


def merging(path: str, keys: list[str], when: str = "replace", order: list[str] | None = None, buckets: int = BUCKETS):
    """A foreachBatch writer that merges batches by keys; a missing key value is a value of its own.

    when: `replace` lets a batch's rows take the place of all that the journal has under their keys, `ignore` keeps what it has,
    `refuse` raises ValueError where it has one of the keys, or the batch repeats one. With order, the last row of a key in a batch
    counts (for `ignore` the first), without it all of them do.
    """
    if when not in ("replace", "ignore", "refuse"):
        raise ValueError(when)

    def write(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        if order is not None and when != "refuse":
            place = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() if when == "ignore" else F.col(c).desc() for c in order])
            batch = batch.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")
        fresh = batch.withColumn("bucket", bucket_of(keys, buckets)).persist()
        try:
            touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most `buckets` values
            held = _commit(spark, path, number)
            if touched:
                old = _buckets(spark, path, {b: at for b, at in held.items() if b in touched}, schema)
                _merged(fresh, old, keys, when, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        finally:
            fresh.unpersist()
        now = held | {b: number for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").json(f"{path}/commits/batch={number}")

    return write
