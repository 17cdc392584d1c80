"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that its successor works on, the last one the
packed pieces. Columns beyond those of documents are dropped; an empty table gives an empty one. A stage's result is written as a table and read again before the next one starts, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import line_dedup, mixing, near_join, packing, quality
from ridgeline.llm.common import scratch, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others; rows without an id and repeated rows each by their own text; labels without
    an id or a value are not learned from.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("predicted = 1").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or place has, up to one edit; n_chars counted anew.

    Every row stays, if need be with an empty text; null texts and rows without an id are as they were (see line_dedup).
    """
    ship(spark)
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that similarities of 0.8 or more connect.

    Null and blank texts and rows without an id are in no group and stay; rows that repeat a doc_id are one document.
    """
    ship(spark)
    gone = near_join.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows alike in doc_id, source and size are taken equally often.

    Rows without a word stay once; a null source is one of its own, a null doc_id an id of its own.
    """
    ship(spark)
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"))
    taken = taken.agg(F.max("copies").alias("copies")).where("copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source"))
    joined = docs.select(COLUMNS).join(taken, same & (mixing.word_count(F.col("text")) == F.col("of_size")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; null and empty texts give a piece of one id."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The classifier, edit distances within a bound, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
