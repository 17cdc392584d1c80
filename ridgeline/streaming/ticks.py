"""Batch forms of the tick operators: running figures, candidates, activity, crossings, triggers, fills.

A tick is a row (symbol, product, ts, seq, price, volume, detail); seq is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import place, valid_price


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as ticks: users as instruments, values as prices, the running number of events as volume."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrival = Window.partitionBy("user_id").orderBy("event_id")
    return events.select(
        F.col("user_id").alias("symbol"), (F.col("user_id") % 4).alias("product"), "ts", F.col("event_id").alias("seq"), valid_price("value").alias("price"),
        F.row_number().over(arrival).cast("long").alias("volume"), F.get_json_object("props", "$.k").cast("int").alias("detail"), "event_type",
    )


def _arrival():
    return Window.partitionBy("symbol").orderBy("seq")


def running_stats(rows: DataFrame) -> DataFrame:
    """One row per symbol: ticks, changes (a tick that differs from the one before; the first is none), latest values.

    The last price is that of the latest tick that has a valid one, as its SQL's arg_max passes missing values over.
    """
    now = F.struct("price", "detail")
    changed = F.coalesce((F.lag(now).over(_arrival()) != now).cast("int"), F.lit(0))
    priced = F.when(F.col("price").isNotNull(), F.col("seq"))  # max_by leaves out rows whose place is NULL
    return rows.withColumn("changed", changed).groupBy("symbol", "product").agg(
        F.count("*").alias("ticks"), F.sum("changed").alias("changes"), F.max_by("volume", "seq").alias("volume"), F.max_by("price", priced).alias("last_price"),
        F.min_by("ts", "seq").alias("first_received"), F.max_by("ts", "seq").alias("last_received"),
    )


def most_active(stats: DataFrame) -> DataFrame:
    """The busiest symbol of each product among those with two ticks, a change and a price; equal ones by the larger symbol."""
    alive = stats.where("ticks >= 2 AND changes >= 1 AND last_price IS NOT NULL")
    best = F.max_by(F.struct("symbol", "volume", "ticks"), F.struct("volume", "ticks", "symbol"))
    return alive.groupBy("product").agg(best.alias("b")).select("product", "b.*")


def latest_quote(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.max_by(F.struct("seq", "ts", "price", "volume"), "seq").alias("q")).select("symbol", "q.*")


def in_order(rows: DataFrame) -> DataFrame:
    """Ticks later than every tick of the symbol that arrived before."""
    latest = F.max("ts").over(_arrival().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("latest", latest).where("latest IS NULL OR ts > latest").drop("latest")


def crossings(rows: DataFrame, threshold: Column, ready: Column | None = None) -> DataFrame:
    """Ticks at which the price goes from at or below the threshold to above it; the first tick never does.

    A tick that is not ready neither fires nor is a price to come from: the next ready one starts anew.
    """
    ready = F.lit(True) if ready is None else F.coalesce(ready, F.lit(False))
    kept = in_order(rows.where("price IS NOT NULL")).withColumn("ready", ready)
    fired = kept.withColumns({"before": F.lag(F.when(F.col("ready"), F.col("price"))).over(_arrival()), "threshold": threshold})
    return fired.where("ready AND before <= threshold AND price > threshold").select("symbol", "seq", "ts", "before", "price", "threshold")


def order_states(reports: DataFrame, order: list[str]) -> DataFrame:
    """Reports of orders (order_id, reported, seq, status, traded, ...) as one row each: the time of the first, the latest of the rest."""
    last = F.max_by(F.struct("status", "traded"), F.struct(*order))
    out = reports.groupBy("order_id").agg(F.min("reported").alias("first_reported"), last.alias("last"), F.count("*").alias("reports"))
    return out.select("order_id", "first_reported", "last.*", "reports")


def trading_status(instruments: DataFrame, statuses: DataFrame) -> DataFrame:
    """instruments (symbol, product) with the latest status that names the symbol or its product, and whether they trade on ('2').

    statuses: (level, name, seq, status), level being symbol or product.
    """
    latest = statuses.groupBy("level", "name").agg(F.max_by(F.struct("seq", "status"), "seq").alias("s"))
    side = lambda level: latest.where(F.col("level") == level).select(F.col("name").alias(f"{level}_name"), F.col("s").alias(f"{level}_s"))
    out = instruments.join(side("symbol"), F.col("symbol") == F.col("symbol_name"), "left").join(side("product"), F.col("product") == F.col("product_name"), "left")
    status = F.greatest("symbol_s", "product_s")["status"]  # the later one; NULLs are passed over
    return out.select("symbol", "product", status.alias("status"), F.coalesce(status == "2", F.lit(False)).alias("trading"))


def anchored_threshold(rows: DataFrame, tick: float = 0.01, steps: int = 2) -> DataFrame:
    """Per symbol the price that was set once at its first valid tick: so many steps above it on the grid."""
    first = rows.where("price IS NOT NULL").groupBy("symbol").agg(F.min_by("price", "seq").alias("first_price"))
    return first.withColumn("threshold", F.round((F.rint(F.col("first_price") / tick) + steps) * tick, 6))


def run_triggers(rows: DataFrame, threshold: Column, length: int = 2) -> DataFrame:
    """Ticks that complete a run of `length` ticks in order above the threshold: islands between resets."""
    rows = in_order(rows.where("price IS NOT NULL")).withColumn("above", F.col("price") > threshold)
    island = F.sum(F.when(F.col("above"), 0).otherwise(1)).over(_arrival().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", island).where("above")
    number = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("seq"))
    return rows.withColumn("run", number).where(F.col("run") == length).select("symbol", "seq", "ts", "price")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as futures contracts: brand as product, size as months to expiry."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("instrument"), F.col("p_brand").alias("product"), F.when(F.col("p_partkey") % 11 == 0, "2").otherwise("1").alias("product_class"),
        (F.col("p_partkey") % 7 != 0).alias("tradable"), F.add_months(F.lit("1995-01-01").cast("date"), F.col("p_size")).alias("expires"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines as reported trades; every fifth is reported twice, some lack a trade id."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("exchange"), F.to_date("l_shipdate").alias("trading_day"),
        F.when(F.col("l_partkey") % 13 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("trade_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), "l_orderkey", "l_linenumber",
    )
    again = rows.where("l_orderkey % 5 = 0")
    return rows.withColumn("arrival", F.lit(1)).unionByName(again.withColumn("arrival", F.lit(2)))


def distinct_fills(rows: DataFrame) -> DataFrame:
    """One row per trade: reports without a trade id are rejected, repeated ones ignored."""
    known = rows.where("trade_id IS NOT NULL")
    first = F.min_by(F.struct("quantity", "amount"), F.struct("arrival", "quantity", "amount"))
    return known.groupBy("exchange", "trading_day", "trade_id").agg(first.alias("f"), F.count("*").alias("reports")).select("exchange", "trading_day", "trade_id", "f.*", "reports")


def positions(rows: DataFrame) -> DataFrame:
    return distinct_fills(rows).groupBy("exchange").agg(F.sum("quantity").alias("position"), F.count("*").alias("trades"), F.round(F.sum("amount"), 2).alias("amount"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines as messages of a query's answer: request id, place, whether it is the last."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    last = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity"))
    return rows.select(F.col("l_orderkey").alias("request_id"), "l_linenumber", "l_partkey", ((last == 1) & (F.col("l_orderkey") % 4 != 0)).alias("is_last"))


def assembled(messages: DataFrame) -> DataFrame:
    """Requests whose last message has come, with the number of rows and their total; others stay open."""
    whole = messages.groupBy("request_id").agg(F.count("*").alias("rows"), F.bool_or("is_last").alias("done"), F.sum("l_partkey").alias("checksum"))
    return whole.where("done").drop("done")


def minute_bars(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Ticks as bars of a fixed width of event time."""
    window = F.window(F.col("ts").cast("timestamp"), width)
    order = F.struct("ts", "seq")
    bars = rows.where("price IS NOT NULL").groupBy("product", window.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks")
    )
    return bars.select("product", F.col("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "ticks")


def event_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("price").isNull()).alias("invalid"))


def front_contracts(rows: DataFrame, today: str, count: int = 6) -> DataFrame:
    live = rows.where(F.col("tradable") & (F.col("product_class") == "1") & (F.col("expires") >= F.lit(today).cast("date")))
    return live.withColumn("place", place("product", order=["expires", "instrument"])).where(F.col("place") <= count).select("product", "place", "instrument", "expires")
