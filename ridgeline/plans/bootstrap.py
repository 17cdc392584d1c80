"""Circular moving-block bootstrap of means over days, as joins and aggregations.

A replicate draws blocks of consecutive days, the series being closed to a ring; days without a signal are
drawn like others and left out of the mean. Block starts come from a hash of (seed, replicate, block), so a
run can be repeated anywhere, in any engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 4000


def block_start(seed: Column, replicate: Column, block: Column, n: Column) -> Column:
    digest = F.md5(F.concat_ws(":", seed.cast("string"), replicate.cast("string"), block.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def intervals(series: DataFrame, block: int, seed: int, replicates: int = REPLICATES, keys: tuple[str, ...] = ("era",), order: str = "day", value: str = "value") -> DataFrame:
    """Per key: the 2.5 % and 97.5 % points of the replicates' means; NULL for fewer than two blocks of days.

    A key's series is one number per market day, held as two lists of running sums; a replicate is one row, whose sum is a sum
    over whole and cut blocks of the ring, looked up in the lists. No drawn day is listed and nothing is joined.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumns({"at": F.row_number().over(ordered), "s": F.sum(F.coalesce(value, F.lit(0.0))).over(upto), "c": F.count(value).over(upto)})
    held = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s", "c"))).alias("p")).where(F.col("n") >= 2 * block)
    # Entry k of a list is the sum of the first k days.
    held = held.select(*keys, "n", F.concat(F.array(F.lit(0.0)), F.transform("p", lambda d: d["s"])).alias("s"), F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda d: d["c"])).alias("c"))
    drawn = held.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    blocks = (F.ceil(F.col("n") / block) - 1).cast("int")

    def cut(b: Column) -> Column:  # the last block is cut to n days in all
        return F.struct(block_start(F.lit(seed), F.col("replicate"), b, F.col("n")).cast("int").alias("start"), F.least(F.lit(block), F.col("n") - b * block).cast("int").alias("length"))

    drawn = drawn.withColumn("cuts", F.transform(F.sequence(F.lit(0), blocks), cut))

    def part(of: str, d: Column) -> Column:
        end = d["start"] + d["length"]
        n = F.col("n").cast("int")
        return F.when(end > n, F.get(of, n) + F.get(of, end - n)).otherwise(F.get(of, end)) - F.get(of, d["start"])

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"))
    add = lambda t, d: F.struct((t["s"] + part("s", d)).alias("s"), (t["c"] + part("c", d)).alias("c"))
    means = drawn.select(*keys, F.aggregate("cuts", zero, add, lambda t: F.try_divide(t["s"], t["c"])).alias("mean"))
    points_of = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*keys).agg(F.count("mean").alias("replicates"), points_of.alias("p"))
    return out.select(*keys, "replicates", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def seeded_intervals(series: DataFrame, block: int, seed: int, replicates: int = REPLICATES, key: str = "era", strict: bool = True) -> DataFrame:
    """The same with numpy's generator of the given seed, one task per key, for comparison with published figures.

    A key's series is one row per market day, so a task holds a few thousand numbers. Where over 1 % of the
    replicates have no signal day, it raises ValueError, or gives NULL if not strict.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        values = part.sort_values("day")["value"].to_numpy(float)
        n = len(values)
        if n < 2 * block:
            return pd.DataFrame({key: [part[key].iloc[0]], "low": [None], "high": [None]})
        rng = np.random.default_rng(seed)
        starts = np.stack([rng.integers(0, n, size=-(-n // block)) for _ in range(replicates)])
        drawn = values[(starts[:, :, None] + np.arange(block)) % n].reshape(replicates, -1)[:, :n]
        seen = np.isfinite(drawn)
        with np.errstate(invalid="ignore"):
            means = np.where(seen, drawn, 0).sum(axis=1) / seen.sum(axis=1)
        means = means[np.isfinite(means)]
        if len(means) < 0.99 * replicates:
            if not strict:
                return pd.DataFrame({key: [part[key].iloc[0]], "low": [None], "high": [None]})
            raise ValueError("too many replicates without a signal day")
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({key: [part[key].iloc[0]], "low": [low], "high": [high]})

    return series.select(key, "day", "value").groupBy(key).applyInPandas(run, f"{key} string, low double, high double")


