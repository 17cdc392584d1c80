"""Structured Streaming forms of the tick operators. State lives in RocksDB by symbol; output follows arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.columns import valid_price

TICK = "symbol long, product long, ts timestamp, seq long, price double, volume long, detail int, event_type string"
STATS = "symbol long, ticks long, changes long, volume long, last_price double, first_received timestamp, last_received timestamp"


def tick_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    rows = spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("price", valid_price("price"))


def running_stats(rows: DataFrame) -> DataFrame:
    """Per batch and symbol the figures so far: ticks, changes, latest values."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Stats(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("stats", "ticks long, changes long, first timestamp, price double, detail int, valid double")

        def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            part = pd.concat(list(parts)).sort_values("seq")
            known = self.state.get()
            signs = list(zip(part["price"].astype(object).where(part["price"].notna(), None), part["detail"].astype(object).where(part["detail"].notna(), None)))
            ticks, changes, first, *before, valid = known if known is not None else (0, 0, part["ts"].iloc[0], *signs[0], None)
            chain = [tuple(before), *signs]
            changes += sum(a != b for a, b in zip(chain, chain[1:]))
            ticks += len(part)
            price, detail = signs[-1]
            valid = next((p for p, _ in reversed(signs) if p is not None), valid)
            self.state.update((ticks, changes, first, price, None if detail is None else int(detail), valid))
            last = part.iloc[-1]
            yield pd.DataFrame({"symbol": [key[0]], "ticks": [ticks], "changes": [changes], "volume": [last["volume"]], "last_price": [valid], "first_received": [first], "last_received": [last["ts"]]})

        def close(self) -> None:
            pass

    return rows.groupBy("symbol").transformWithStateInPandas(Stats(), outputStructType=STATS, outputMode="Update", timeMode="None")


def crossings(rows: DataFrame, threshold: float) -> DataFrame:
    """Ticks that cross the threshold from below; ticks that are not later than the last accepted one are ignored.

    Where rows have a column ready, a tick without it neither fires nor counts as a price to come from.
    """
    rows = rows if "ready" in rows.columns else rows.withColumn("ready", F.lit(True))
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Crossing(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("last", "ts timestamp, price double")

        def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            part = pd.concat(list(parts)).sort_values("seq")
            known = self.state.get()
            at, before = known if known is not None else (None, None)
            found = []
            for seq, ts, price, ready in part.loc[part["price"].notna(), ["seq", "ts", "price", "ready"]].itertuples(index=False):
                if at is not None and ts <= at:
                    continue
                ready = ready is not None and bool(ready)
                if ready and before is not None and before <= threshold < price:
                    found.append((key[0], seq, ts, before, price))
                at, before = ts, price if ready else None
            if at is not None:
                self.state.update((at, before))
            yield pd.DataFrame(found, columns=["symbol", "seq", "ts", "before", "price"])

        def close(self) -> None:
            pass

    schema = "symbol long, seq long, ts timestamp, before double, price double"
    return rows.groupBy("symbol").transformWithStateInPandas(Crossing(), outputStructType=schema, outputMode="Append", timeMode="None")


def distinct_fills(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Trades once each: repeats of an identity within the delay go, those without a trade id too."""
    known = rows.where("trade_id IS NOT NULL").withWatermark("reported", delay)
    return known.dropDuplicatesWithinWatermark(["exchange", "trading_day", "trade_id"])


def bars(rows: DataFrame, width: str = "1 minute", delay: str = "2 seconds") -> DataFrame:
    """Bars of a fixed width of event time, each given once the watermark is past its end."""
    order = F.struct("ts", "seq")
    grouped = rows.where("price IS NOT NULL").withWatermark("ts", delay).groupBy("product", F.window("ts", width).alias("w"))
    out = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks"))
    return out.select("product", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def event_sink(rows: DataFrame, path: str, checkpoint: str, kinds: list[str]) -> None:
    """Writes the events of some kinds as JSON lines, once each, and stops when all that is there is written."""
    chosen = rows.where(F.col("event_type").isin(kinds))
    chosen.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def insert_once(path: str, keys: list[str]):
    """A foreachBatch writer that adds rows whose key the journal does not hold yet.

    A batch has a folder of its own, which a replay writes anew, so that a batch that failed half way counts once.
    Only keys are read back, and only those of earlier batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            held = spark.read.parquet(path).where(F.col("batch") < number).select(*keys)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            held = None
        if held is not None:
            fresh = fresh.join(held, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(rows: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over what is there and stops: rows of an append stream go to a Parquet sink."""
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
