"""Where events come from and go: envelopes, two inputs as one, routing to those who asked, and whose order a report is of.

Every function takes batch or streamed events; the tables that they are met with are static.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enveloped(rows: DataFrame, kind: str) -> DataFrame:
    """rows with kind, received_at (the time of the batch unless they bring their own) and received_mono, its seconds."""
    at = F.coalesce(F.col("received_at").cast("timestamp"), F.current_timestamp()) if "received_at" in rows.columns else F.current_timestamp()
    return rows.withColumn("received_at", at).withColumns({"kind": F.lit(kind), "received_mono": F.unix_micros("received_at") / F.lit(1e6)})


def one_stream(market: DataFrame, trading: DataFrame) -> DataFrame:
    """Market and trading events as one: columns that one side lacks are NULL there."""
    return market.unionByName(trading, allowMissingColumns=True)


def wanted(events: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """Events that someone waits for: ticks of the symbols (symbol), messages of the requests (request_id), and all others.

    Either table is met by key; an event without the key that its kind is routed by goes nowhere.
    """
    of = events.join(symbols.select(F.col("symbol").alias("__symbol")).distinct(), F.col("symbol") == F.col("__symbol"), "left")
    of = of.join(requests.select(F.col("request_id").alias("__request")).distinct(), F.col("request_id") == F.col("__request"), "left")
    lost = ((F.col("kind") == "tick") & F.col("__symbol").isNull()) | ((F.col("kind") == "answer") & F.col("__request").isNull())
    return of.where(~lost).drop("__symbol", "__request")


def owners(reports: DataFrame, intents: DataFrame) -> DataFrame:
    """Reports (instrument, order_ref, front, session, sys_id, ...) with the role of the intent that they are of, or NULL.

    intents: (role, instrument, order_ref, front, session, sys_id), one for each instrument and order_ref. Front and session
    count where the report names a front; sys_id counts where the intent's is known already, and then has to be there.
    """
    sides = [F.col(c).alias(f"__{c}") for c in ("instrument", "order_ref", "front", "session", "sys_id")]
    same = (F.col("instrument") == F.col("__instrument")) & (F.col("order_ref") == F.col("__order_ref"))
    same &= F.col("front").isNull() | (F.col("front").eqNullSafe(F.col("__front")) & F.col("session").eqNullSafe(F.col("__session")))
    same &= F.col("__sys_id").isNull() | F.coalesce(F.col("sys_id") == F.col("__sys_id"), F.lit(False))
    return reports.join(intents.select("role", *sides), same, "left").drop("__instrument", "__order_ref", "__front", "__session", "__sys_id")


def merged_maps(first: Column, second: Column) -> Column:
    """The entries of both maps, those of the second where both have a key; a missing map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def only_keys(entries: Column, keys: list[str]) -> Column:
    """The entries under some keys."""
    return F.map_filter(entries, lambda k, _: k.isin(*keys))


def verified(selected: DataFrame, stats: DataFrame) -> DataFrame:
    """Selected symbols with what came of them, and whether they were seen to change."""
    seen = stats.select(F.col("symbol").alias("__symbol"), "ticks", "changes")
    joined = selected.select("symbol").distinct().join(seen, F.col("symbol") == F.col("__symbol"), "left").drop("__symbol")
    return joined.withColumn("verified", F.coalesce(F.col("changes") > 0, F.lit(False)))


def exit_code(checked: DataFrame) -> int:
    """0 if every selected symbol is verified and there is one, 2 otherwise: one count over the selection."""
    found = checked.agg(F.count("*").alias("n"), F.count_if(~F.col("verified")).alias("bad")).first()
    return 0 if found["n"] and not found["bad"] else 2


def console(rows: DataFrame, checkpoint: str, lines: int = 20):
    """Prints each batch of a stream as lines of JSON; gives the query, which ends when what is there is printed."""
    shown = rows.select(F.to_json(F.struct("*")).alias("event"))
    return shown.writeStream.format("console").option("truncate", False).option("numRows", lines).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
