"""Document fingerprints: canonical exact digests.

The canonical form of a text is its NFKC normal form, case-folded, with runs of white space as one blank
and none at the ends. Its 128-bit xxhash names the bucket; inside a bucket that holds more than one text
the canonical bytes themselves are compared, and different texts of one bucket get different fingerprints
(the second in byte order ends in -1, and so on). So fingerprints are equal exactly if canonical texts are.

Cases: null texts count as empty; equal rows have equal fingerprints; empty tables give empty results;
the order of documents is descending doc_id, rows that share an id by text; rows without an id come last, in order
of a hash of the text, then the text, and are dealt to ranges of their own by it; very long texts are whole; other
columns are not read (by `fingerprint`: are kept, a column named fingerprint is replaced).
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import by_ranges, keep

BROADCAST_IDS = 1_000_000
#: Text of one range of documents, which one task reads: at most, and at least where the cluster has more cores.
PART_BYTES, LEAST_PART_BYTES = 64_000_000, 4_000_000


def canonical(text: str | None) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split()).encode("utf-8", "replace")


def bucket_hash(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def canonical_udf(column: str):
    @F.pandas_udf("binary")
    def canon(text: pd.Series) -> pd.Series:
        return text.map(canonical)

    return canon(column)


def _resolve(texts: DataFrame) -> DataFrame:
    """Rows (hash, canon, rank) of buckets whose texts differ; texts: rows (hash, canon).

    distinct() compares the whole bytes, and combines equal copies before it shuffles them.
    """
    apart = texts.select("hash", "canon").distinct()
    mixed = apart.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("hash").orderBy("canon")
    return apart.join(mixed, "hash").select("hash", "canon", (F.row_number().over(order) - 1).alias("rank"))


def _narrow(ids: DataFrame):
    """ids as a join side: broadcast if it has few rows, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def fingerprint(documents: DataFrame, hash_bits: int = 128) -> DataFrame:
    """documents with the column fingerprint. hash_bits: fewer make buckets mix, for tests."""
    digits = hash_bits // 4

    @F.pandas_udf("string")
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: bucket_hash(canonical(t))[:digits])

    out = documents.withColumn("__hash", hashed("text"))
    counts = out.groupBy(F.col("__hash").alias("hash")).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("text")).alias("texts"))
    shared = counts.where("texts > 1").select("hash")
    members = out.join(_narrow(shared), F.col("__hash") == F.col("hash"), "left_semi")
    ranks = keep(_resolve(members.select(F.col("__hash").alias("hash"), canonical_udf("text").alias("canon"))))
    if ranks.isEmpty():
        return out.withColumn("fingerprint", F.col("__hash")).drop("__hash")
    full = out.withColumn("__canon", canonical_udf("text"))
    joined = full.join(ranks, (F.col("__hash") == F.col("hash")) & (F.col("__canon") == F.col("canon")), "left")
    named = F.when(F.coalesce("rank", F.lit(0)) == 0, F.col("__hash")).otherwise(F.concat_ws("-", "__hash", "rank"))
    return joined.withColumn("fingerprint", named).drop("__hash", "__canon", "hash", "canon", "rank")


MARKS = "doc_id long, next_id long, n_chars long, edited_sha256 string, hash string, edited_hash string, near_edited double, near_next double"


def _marks(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (bucket, doc_id, text, extra) in order: what each row and its successor give.

    A row marked extra opens the next bucket and only serves as successor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("next_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("hash", pa.string()), ("edited_hash", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(held, following):
        (doc_id, text, canon), (next_id, next_text, next_canon) = held, following
        new = edited(text, next_text)
        new_canon = canonical(new)
        return (doc_id, next_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), bucket_hash(canon),
                bucket_hash(new_canon), float(canon == new_canon), float(canon == next_canon))

    held = held_bucket = None
    for batch in part:
        out = []
        columns = batch.to_pydict()
        for bucket, doc_id, text, extra in zip(columns["bucket"], columns["doc_id"], columns["text"], columns["extra"]):
            now = (doc_id, text, canonical(text))
            if held is not None and bucket == held_bucket:
                out.append(row(held, now))
            held, held_bucket = (None, None) if extra else (now, bucket)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def compare_edited(documents: DataFrame, hash_bits: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness: 1 if canonical texts are equal, else 0.

    The successor of the last document is the first. Documents are cut into ranges of doc_id; the row that
    opens a range is also sent to the end of the range before it, so one shuffle brings all neighbours together.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    bounds, docs = by_ranges(docs, "number", F.xxhash64("text"), PART_BYTES, LEAST_PART_BYTES)
    count = len(bounds) + 1
    # Range 0 holds the largest ids; those of rows without an id come last.
    bucket = F.when(F.col("doc_id").isNull(), count + F.col("number")).otherwise(2 * count - 1 - F.col("number"))
    docs = docs.select("doc_id", "text", bucket.alias("bucket"), tie.alias("tie"))
    opens = docs.groupBy("bucket").agg(F.max("doc_id").alias("opens"), F.min("tie").alias("opens_tie"))
    used = sorted((r["bucket"], r["opens"], r["opens_tie"]) for r in opens.collect())  # one row per range
    if not used:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    following = [(b, o, t, used[i - 1][0]) for i, (b, o, t) in enumerate(used)]  # the first range follows the last
    table = spark.createDataFrame(following, "of int, opens long, opens_tie long, to int")
    same = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("opens")) & F.col("tie").eqNullSafe(F.col("opens_tie"))
    # Of rows that share the opening id, the first in order opens the range.
    heads = docs.join(F.broadcast(table), same).groupBy("of", "to", "doc_id", "tie").agg(F.min("text").alias("text"))
    heads = heads.select("doc_id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("extra"))
    everything = docs.withColumn("extra", F.lit(False)).unionByName(heads)
    ordered = everything.repartition(len(used), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "tie", "text")
    marks = keep(ordered.select("bucket", "doc_id", "text", "extra").mapInArrow(_marks, MARKS))
    digits = hash_bits // 4
    marks = marks.withColumns({"hash": F.substring("hash", 1, digits), "edited_hash": F.substring("edited_hash", 1, digits)})

    both = marks.select("doc_id", "next_id", "hash", F.lit(False).alias("new")).unionByName(
        marks.select("doc_id", "next_id", F.col("edited_hash").alias("hash"), F.lit(True).alias("new"))
    )
    shared = both.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    members = keep(both.join(shared, "hash"))
    plain = docs.select("doc_id", "text").join(_narrow(members.where("NOT new").select("doc_id").distinct()), "doc_id")
    changed = members.where("new").select("doc_id", "next_id").distinct()
    needed = changed.select("doc_id").unionByName(changed.select(F.col("next_id").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(_narrow(needed), "doc_id")
    following = texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    changed = texts.join(changed, "doc_id").join(following, "next_id")

    @F.pandas_udf("binary")
    def edited_canonical(text: pd.Series, next_text: pd.Series) -> pd.Series:
        return pd.Series([canonical(edited(a, b)) for a, b in zip(text, next_text)], dtype=object)

    @F.pandas_udf("string")
    def hashed(canon: pd.Series) -> pd.Series:
        return canon.map(lambda c: bucket_hash(bytes(c))[:digits])

    canons = plain.select(canonical_udf("text").alias("canon")).unionByName(changed.select(edited_canonical("text", "next_text").alias("canon")))
    canons = canons.distinct()
    ranks = _resolve(canons.select(hashed("canon").alias("hash"), "canon"))
    ranks = keep(ranks.where("rank > 0"))
    out = marks
    if ranks.isEmpty():
        out = out.withColumns({"fingerprint": F.col("hash"), "edited_fingerprint": F.col("edited_hash")})
    else:
        def name(side: DataFrame, canon, hash_col: str, as_name: str) -> DataFrame:
            own = side.select("doc_id", canon.alias("c")).withColumn("h", hashed("c")).join(
                ranks, (F.col("h") == F.col("hash")) & (F.col("c") == F.col("canon"))
            ).select("doc_id", F.col("h").alias(hash_col), "rank").distinct()
            joined = out.join(own, ["doc_id", hash_col], "left")
            named = F.when(F.col("rank").isNull(), F.col(hash_col)).otherwise(F.concat_ws("-", hash_col, "rank"))
            return joined.withColumn(as_name, named).drop("rank")

        out = name(plain, canonical_udf("text"), "hash", "fingerprint")
        out = name(changed, edited_canonical("text", "next_text"), "edited_hash", "edited_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
