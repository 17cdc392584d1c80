"""Bar panels, market calendars and membership: the inputs of every study.

A bar is one row (vt_symbol, day, open, high, low, close, volume, turnover, vwap, tradestatus, is_st).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources import files

REQUIRED = {"vt_symbol", "day", "open", "high", "low", "close", "volume"}
#: A signal's entry is so many market days on, and its exit.
ENTRY, EXIT = 1, 6
MEMBER_FROM, MEMBER_UNTIL = "1995-01-02", "2001-12-31"


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by supplier from the sales table: one map-side combined aggregation, then a small join."""
    sales = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price")
    sales = sales.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    bars = sales.groupBy("l_suppkey", week.alias("day")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
    )
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).cast("int").alias("is_st")
    )
    bars = bars.join(suppliers, "l_suppkey", "left").withColumn("is_st", F.coalesce("is_st", F.lit(0)))
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("vt_symbol")
    status = F.when(F.col("volume") < 5, 0).otherwise(1).alias("tradestatus")
    vwap = F.try_divide(F.col("turnover"), F.col("volume")).alias("vwap")
    return bars.select(symbol, "l_suppkey", "day", "open", "high", "low", "close", "volume", "turnover", vwap, status, "is_st")


def bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars as a table that a study reads more than once: made once and checkpointed.

    The panel and the market calendar read it; without it both would scan and aggregate the sales anew. It is far smaller than the sales,
    survives its executors, and belongs to this call: another study makes its own, from the sales as they are then. A checkpoint keeps no
    partitioning, so the panel deals it by symbol, once.
    """
    files.shared_folder(spark)
    return weekly_bars(spark, sf_dir).checkpoint()


def normalised(raw: DataFrame) -> DataFrame:
    """raw as a bar panel: day from datetime or date, vt_symbol from code, status columns added where they miss.

    Raises ValueError if a required column is absent.
    """
    names = {"code": "vt_symbol", "isST": "is_st"}
    out = raw.withColumnsRenamed({old: new for old, new in names.items() if old in raw.columns and new not in raw.columns})
    if "day" not in out.columns:
        source = next((c for c in ("datetime", "date") if c in out.columns), None)
        if source:
            out = out.withColumn("day", F.to_date(source))
    if "tradestatus" not in out.columns:
        out = out.withColumns({"tradestatus": F.lit(1), "is_st": F.lit(0)})
    if missing := REQUIRED - set(out.columns):
        raise ValueError(f"these columns are missing: {sorted(missing)}")
    return out


def exchange_code(symbol: Column) -> Column:
    """600000.SSE as sh.600000, 000001.SZSE as sz.000001."""
    parts = F.split(symbol, r"\.")
    return F.concat(F.when(parts[1] == "SSE", "sh.").otherwise("sz."), parts[0])


def market_days(bars: DataFrame) -> DataFrame:
    """day, ordinal from 0, entry_day (next market day), exit_day (six on): one row for each market day of all bars.

    The windows run over distinct days, a few hundred a year whatever the number of symbols.
    """
    from pyspark.sql import Window

    days = bars.select("day").distinct()
    order = Window.orderBy("day")
    return days.select(
        "day", (F.row_number().over(order) - 1).alias("ordinal"), F.lead("day", ENTRY).over(order).alias("entry_day"), F.lead("day", EXIT).over(order).alias("exit_day")
    )


def schedule(days: DataFrame, start: str, end: str, step: int = 6, offset: int = 0, exact: bool = False) -> DataFrame:
    """Every step-th market day from the first one on or after start, with its entry and exit day, exit by end.

    offset moves the first day on; exact asks that start itself is a market day and gives nothing otherwise.
    """
    anchor = days.where(F.col("day") == F.lit(start).cast("date") if exact else F.col("day") >= F.lit(start).cast("date"))
    anchor = anchor.agg((F.min("ordinal") + offset).alias("anchor"))
    joined = days.crossJoin(F.broadcast(anchor))  # one row
    inside = (F.col("ordinal") >= F.col("anchor")) & ((F.col("ordinal") - F.col("anchor")) % step == 0) & F.col("day").between(start, end)
    return joined.where(inside & (F.col("exit_day") <= F.lit(end).cast("date"))).select("day", "entry_day", "exit_day", "ordinal")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership intervals (vt_symbol, member_start, member_end); every seventh symbol left for a while and came back."""
    key = F.col("s_suppkey")
    start = F.date_add(F.lit(MEMBER_FROM).cast("date"), (key % 5 * 90).cast("int"))
    first = F.struct(start.alias("member_start"), F.when(key % 7 == 0, F.date_add(start, 1400)).otherwise(F.lit(MEMBER_UNTIL).cast("date")).alias("member_end"))
    again = F.struct(F.date_add(start, 1500).alias("member_start"), F.lit(MEMBER_UNTIL).cast("date").alias("member_end"))
    spans = F.when(key % 7 == 0, F.array(first, again)).otherwise(F.array(first))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return suppliers.select(F.concat(F.lit("S"), key.cast("string")).alias("vt_symbol"), F.inline(spans))


def members_only(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval join: bars on days of their symbol's membership. An equi-join on the symbol with the range as residual."""
    return bars.join(intervals, "vt_symbol").where(F.col("day").between(F.col("member_start"), F.col("member_end"))).drop("member_start", "member_end")


def overlapping(intervals: DataFrame) -> DataFrame:
    """Symbols whose intervals overlap, which would duplicate their days."""
    from pyspark.sql import Window

    before = F.max("member_end").over(Window.partitionBy("vt_symbol").orderBy("member_start", "member_end").rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("before", before).where("member_start <= before").select("vt_symbol").distinct()


def snapshot_members(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """The members (day, vt_symbol) of each of the given days: days are few, so they are the broadcast side."""
    dates = F.broadcast(days.select("day"))
    return intervals.join(dates, F.col("day").between(F.col("member_start"), F.col("member_end"))).select("day", "vt_symbol")


def first_day_of_weeks(days: DataFrame) -> DataFrame:
    """The first market day of each ISO week."""
    year, week = F.extract(F.lit("YEAROFWEEK"), "day"), F.weekofyear("day")
    return days.groupBy(year.alias("iso_year"), week.alias("iso_week")).agg(F.min("day").alias("day"))
