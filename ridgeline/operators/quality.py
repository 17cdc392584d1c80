"""Data quality of a bar panel against its membership, as a handful of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import finite
from ridgeline.operators import checks

NUMBERS = ("open", "high", "low", "close", "volume", "turnover", "vwap")


def figures(bars: DataFrame) -> DataFrame:
    """One row (measure, value) per measure, from one pass: rows, symbols, nulls, non-finite and non-positive values, odd bars."""
    c = F.col
    bad = (c("high") < F.greatest("open", "low", "close")) | (c("low") > F.least("open", "high", "close"))
    measures = {
        "rows": F.count("*"), "symbols": F.count_distinct("vt_symbol"), "days": F.count_distinct("day"), "invalid_ohlc": F.count_if(bad),
        "zero_volume": F.count_if(c("volume") == 0), "negative_volume": F.count_if(c("volume") < 0), "weekend": F.count_if(F.weekday("day") >= 5),
        "vwap_outside": F.count_if((c("vwap") > c("high") * 1.011) | (c("vwap") < c("low") * 0.989)),
    }
    for n in NUMBERS:
        measures |= {f"null_{n}": F.count_if(c(n).isNull()), f"nonfinite_{n}": F.count_if(~finite(n)), f"nonpositive_{n}": F.count_if(c(n) <= 0)}
    row = bars.agg(*[x.cast("long").alias(n) for n, x in measures.items()])
    return row.unpivot([], list(measures), "measure", "value")


def largest_moves(panel: DataFrame, count: int = 12) -> DataFrame:
    """The largest daily moves: a top-k report, equal ones by day and symbol."""
    moves = panel.where(F.col("day_return").isNotNull()).select("vt_symbol", "day", F.round("day_return", 6).alias("day_return"))
    return moves.orderBy(F.abs("day_return").desc(), "day", "vt_symbol").limit(count)


def coverage(bars: DataFrame) -> DataFrame:
    """Per symbol: first and last day, rows, first close, days per year."""
    return bars.groupBy("vt_symbol").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("rows"), F.min_by("close", "day").alias("first_close"), F.count_distinct(F.year("day")).alias("years")
    )


def by_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("rows"), F.count_distinct("vt_symbol").alias("symbols"), F.count_if(F.col("volume") == 0).alias("zero_volume"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def members_without_bars(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Days on which a member has no bar: how many, and who comes first."""
    missing = members.join(bars.select("day", "vt_symbol"), ["day", "vt_symbol"], "left_anti")
    return missing.groupBy("day").agg(F.count("*").alias("missing"), F.min("vt_symbol").alias("first_missing"))


def checked_members(members: DataFrame, least: int, most: int) -> DataFrame:
    """members (day, vt_symbol), or ValueError: a repeated member, or a day with fewer or more of them than a snapshot can have."""
    return checks.members(members, least, most).verify()


def checked_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """bars, or ValueError if they have a day that is no market day of the calendar, or miss one between their first and last."""
    checks.calendar(bars, calendar).verify()
    return bars


def union_of_members(snapshots: DataFrame) -> DataFrame:
    """Every symbol that any snapshot (day, vt_symbol) holds, with the first and last of them."""
    return snapshots.groupBy("vt_symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("snapshots"))


def member_counts(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """How many days have how many members: an interval join against the few market days, then two counts."""
    dates = F.broadcast(days.select("day"))  # one row per market day
    per_day = intervals.join(dates, F.col("day").between(F.col("member_start"), F.col("member_end"))).groupBy("day").agg(F.count("*").alias("members"))
    return per_day.groupBy("members").agg(F.count("*").alias("days"), F.min("day").alias("first_day"))


def frozen_prices(bars: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least `least` bars of a symbol with one close: gaps and islands."""
    order = Window.partitionBy("vt_symbol").orderBy("day")
    moved = F.when(F.col("close") == F.lag("close").over(order), 0).otherwise(1)
    island = F.sum("moved").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = bars.withColumn("moved", moved).withColumn("island", island).groupBy("vt_symbol", "island")
    return runs.agg(F.min("day").alias("first_day"), F.count("*").alias("bars")).where(F.col("bars") >= least).drop("island")
