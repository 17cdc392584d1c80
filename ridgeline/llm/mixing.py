"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of their id and pass through the source's queue in that
order, up to three times. A document's virtual finish time is the number of its source's words up to and
including it, divided by the source's target. All queues are then merged by virtual time and the merged
order is truncated at the total budget, which is the number of words in the corpus.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, last in
order; repeated rows are separate documents; an empty table gives an empty table; columns whose names
clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import keep, partitions, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Targets are min(repeats * size, level * weight) with the one level at which they sum to all words:
    what sources that stop at their bound leave over is reshared by weight until none is above it.
    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    shares = F.array(*[F.lit(float(w)) for w in weights])
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(by_name) - 1)
    sources = sources.withColumn("weight", F.element_at(shares, F.col("place") % len(weights) + 1))
    sources = sources.withColumn("bound", F.col("source_size") * F.lit(float(repeats)))
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "bounded": F.coalesce(F.sum("bound").over(earlier), F.lit(0.0)),
            "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    )
    sources = sources.withColumn("level", (F.col("total") - F.col("bounded")) / F.col("open_weight"))
    # Along the sources by bound / weight this rises while bounds are met and falls after: the top is the level.
    sources = sources.withColumn("level", F.max("level").over(everything))
    target = F.least("bound", F.col("level") * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, copies), one per row of documents.

    taken is the number of words the mix takes from the row, repeats counted; copies is how often it
    takes the row: 0 to repeats, and at most 1 for rows of size 0.
    """
    spark = documents.sparkSession
    buckets = 4 * partitions(spark)
    shuffle = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    slim = documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffle.alias("draw")
    )
    slim = slim.withColumn(
        "bucket", F.floor(F.conv(F.substring("draw", 1, 6), 16, 10).cast("long") * buckets / F.lit(16**6)).cast("int")
    )
    slim = keep(slim)
    goals = targets(slim, weights, repeats).withColumnRenamed("source", "of_source")
    order = ["draw", F.col("doc_id").asc_nulls_last(), "size"]
    queued = running(slim, ["source"], "bucket", order, {"before": F.col("size")})
    queued = queued.join(goals, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    queued = queued.withColumn("finish", F.try_divide(F.col("before") + F.col("size"), F.col("target")))
    queued = keep(queued.select("doc_id", "source", "size", "source_size", "target", "draw", "finish"))

    # Passes 0, 1, 2 of a source's queue follow each other at a distance of source_size / target.
    step = F.try_divide(F.col("source_size"), F.col("target"))
    passes = queued.where("size > 0 AND target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("finish", F.col("finish") + F.col("pass") * step)
    budget = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    slices = 4 * buckets

    def slice_of(finish: Column) -> Column:
        return F.least(F.floor(finish * slices), F.lit(2 * slices)).cast("long")

    passes = passes.withColumn("slice", slice_of(F.col("finish")))
    totals = passes.groupBy("slice").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # Only the slice of virtual time in which the budget runs out has to be put in order row by row.
    last = totals.crossJoin(F.broadcast(budget)).where("before < budget").agg(
        F.max_by(F.struct("slice", "before", "budget"), "slice").alias("last")
    )
    edge = passes.join(F.broadcast(last), F.col("slice") == F.col("last.slice"))
    merged = Window.partitionBy("slice").orderBy("finish", "draw", F.col("doc_id").asc_nulls_last(), "pass", "size")
    edge = edge.withColumn("upto", F.col("last.before") + F.sum("size").over(merged.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("fits", F.col("upto") <= F.col("last.budget"))
    cut = edge.agg(
        F.max(F.when(F.col("fits"), F.struct("finish", "draw"))).alias("cut"), F.max("slice").alias("last_slice")
    )
    taken = queued.crossJoin(F.broadcast(cut))
    taken_passes = sum(
        F.when(
            (F.col("size") > 0)
            & (
                (slice_of(F.col("finish") + F.lit(i) * step) < F.col("last_slice"))
                | (
                    F.col("cut").isNotNull()
                    & (F.struct((F.col("finish") + F.lit(i) * step).alias("finish"), F.col("draw")) <= F.col("cut"))
                )
            ),
            1,
        ).otherwise(0)
        for i in range(repeats)
    )
    empty = F.when((F.col("size") == 0), F.lit(1)).otherwise(F.lit(0))
    taken = taken.withColumn("copies", F.coalesce(F.greatest(taken_passes, empty), F.lit(0)))
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )
