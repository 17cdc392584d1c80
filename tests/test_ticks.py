"""Tick figures against their SQL on rows that the test tables lack."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ridgeline.streaming import live, ticks


@pytest.fixture
def folder(spark, tmp_path):
    first = datetime(2024, 1, 1)
    values = [(1, 5.0), (1, 7.0), (1, 0.0), (2, 0.0), (2, 3.0), (2, -1.0), (2, None), (3, 0.0), (4, 9.0)]
    rows = [(k, first + timedelta(seconds=k), user, "view", value, '{"k": 3}') for k, (user, value) in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return tmp_path


def test_a_symbol_that_ends_without_a_price_keeps_its_last_one(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    for name in ("tick_statistics", "most_active_symbols"):
        got = __spark_entry__.queries()[name](spark, str(folder))
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    stats = {r.symbol: r.last_price for r in ticks.running_stats(ticks.ticks(spark, str(folder))).collect()}
    assert stats == {1: 7.0, 2: 3.0, 3: None, 4: 9.0}


def test_stream_figures_keep_the_last_price(spark, folder, tmp_path):
    rows = ticks.ticks(spark, str(folder)).withColumn("ts", F.col("ts").cast("timestamp")).select(*[f.split()[0] for f in live.TICK.split(", ")])
    for k, part in enumerate(("seq < 2 OR seq = 4", "seq >= 2 AND seq <> 4")):  # the price and what follows it in two batches
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / "ticks" / str(k)))
    last = {}
    stream = live.running_stats(live.tick_stream(spark, str(tmp_path / "ticks" / "*")))
    stream.writeStream.foreachBatch(lambda batch, _: last.update({r.symbol: r.last_price for r in batch.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert last == {1: 7.0, 2: 3.0, 3: None, 4: 9.0}
