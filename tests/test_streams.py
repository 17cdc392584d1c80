"""Rules by table, the order lifecycle by scenario, and streams against their batch forms."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import valid_price
from ridgeline.sources import files
from ridgeline.streaming import lifecycle, live, rules, ticks

SF = "/root/testdata/sf0.001"
QUOTE = {"received_age": 0.5, "trading_day": "d", "day": "d", "exchange_lag": 0.2, "last": 1000.0, "bid": 999.0, "ask": 1001.0, "lower": 900.0, "upper": 1100.0, "bid_volume": 1, "ask_volume": 1, "step": 1.0}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, ""), ({"step": 0.0}, "invalid_tick_size"), ({"received_age": 2.1}, "receive_stale"), ({"received_age": -1.0}, "receive_stale"), ({"trading_day": "e"}, "wrong_trading_day"),
        ({"exchange_lag": 2.5}, "exchange_stale_or_future"), ({"exchange_lag": -0.6}, "exchange_stale_or_future"), ({"ask": 0.0}, "invalid_price"), ({"last": 1e101}, "invalid_price"),
        ({"last": None}, "invalid_price"), ({"lower": 1100.0}, "invalid_limits"), ({"ask_volume": 0}, "empty_book"), ({"bid_volume": None}, "incomplete_quote"), ({"last": 1000.5}, "price_outside_limits_or_tick"),
        ({"last": 1101.0}, "price_outside_limits_or_tick"), ({"bid": 1002.0}, "crossed_book"), ({"bid": 995.0}, "spread_too_wide"), ({"last": 1099.0}, "near_price_limit"), ({"received_age": None}, "incomplete_quote"),
    ],
)
def test_quote_reasons(spark, change, reason):
    schema = "received_age double, trading_day string, day string, exchange_lag double, last double, bid double, ask double, lower double, upper double, bid_volume int, ask_volume int, step double"
    frame = spark.createDataFrame([tuple((QUOTE | change).values())], schema)
    assert frame.select(rules.quote_reason().alias("r")).first().r == reason


def test_sessions(spark):
    times = {"2026-09-24 09:00:00": 4500, "2026-09-24 10:15:00": 0, "2026-09-24 10:30:00": 3600, "2026-09-24 14:59:59": 1, "2026-09-24 15:00:00": 0, "2026-09-24 21:00:00": 19800,
             "2026-09-26 02:29:00": 60, "2026-09-26 09:30:00": 0, "2026-09-27 21:30:00": 0, "2026-09-28 01:00:00": 0}
    frame = spark.createDataFrame([(datetime.fromisoformat(t), s) for t, s in times.items()], "t timestamp, s int")
    assert all(r.got == r.s for r in frame.select("s", rules.seconds_to_break(F.col("t")).alias("got")).collect())


def test_valid_price(spark):
    frame = spark.createDataFrame([("1.5",), ("0",), ("-1",), ("1e100",), ("NaN",), ("Infinity",), ("x",), (None,)], "p string")
    assert [r.v for r in frame.select(valid_price("p").alias("v")).collect()] == [1.5] + [None] * 7


def event(run, seq, mono, kind, **more):
    row = dict(role=None, status=None, trade_id=None, price=None, volume=0, last=10.0, bid=9.9, ask=10.1, ready=True, seconds_left=900.0) | more
    return (run, seq, float(mono), kind, *(row[k] for k in ("role", "status", "trade_id", "price", "volume", "last", "bid", "ask", "ready", "seconds_left")))


OPENED = [("quote", 0, {}), ("quote", 1, {"last": 10.3}), ("quote", 2, {"last": 10.3}), ("order", 3, {"role": "open", "status": "3"}), ("trade", 4, {"role": "open", "trade_id": "t1", "price": 10.3, "volume": 1})]
SCENARIOS = {
    "normal": ([*OPENED, ("trade", 4, {"role": "open", "trade_id": "t1", "volume": 1}), ("quote", 65, {}), ("order", 66, {"role": "close", "status": "3"}), ("trade", 67, {"role": "close", "trade_id": "t2", "price": 9.7, "volume": 1}), ("flat", 68, {})], ("closed", 2, None, "time_limit")),
    "stop_loss": ([*OPENED, ("quote", 10, {"bid": 5.0})], ("close_pending", 2, None, "stop_loss")),
    "one_tick_only": ([("quote", 0, {}), ("quote", 1, {"last": 10.3}), ("quote", 2, {}), ("quote", 3, {"last": 10.3})], ("waiting", 0, None, None)),
    "no_ack": ([*OPENED[:3], ("clock", 6, {})], ("open_pending", 1, "no acknowledgement", None)),
    "canceled": ([*OPENED[:4], ("clock", 13, {}), ("order", 14, {"role": "open", "status": "5"})], ("canceled", 1, None, None)),
    "cancel_lost": ([*OPENED[:4], ("clock", 13, {}), ("clock", 19, {})], ("open_pending", 1, "cancel not acknowledged", None)),
    "no_details": ([*OPENED[:3], ("order", 3, {"role": "open", "status": "0"}), ("clock", 8, {})], ("open_pending", 1, "filled order without trade details", None)),
    "disconnect": ([("quote", 0, {}), ("disconnect", 1, {}), ("quote", 2, {"last": 11.0}), ("quote", 3, {"last": 11.0})], ("waiting", 0, "disconnected", None)),
    "not_flat": ([*OPENED, ("quote", 65, {}), ("trade", 66, {"role": "close", "trade_id": "t2", "price": 9.7, "volume": 1}), ("flat", 67, {"volume": 1})], ("verifying_flat", 2, "position or order left after the close", "time_limit")),
    "nameless": ([*OPENED[:4], ("trade", 4, {"role": "open", "price": 1.0, "volume": 1})], ("open_pending", 1, "trade without identity", None)),
    "stopped": ([*OPENED, ("stop", 9, {}), ("quote", 10, {})], ("close_pending", 2, None, "user_stop")),
}


def test_lifecycle_in_batch_and_stream(spark, tmp_path):
    rows = [event(name, k, mono, kind, **more) for name, (steps, _) in SCENARIOS.items() for k, (kind, mono, more) in enumerate(steps)]
    log = spark.createDataFrame(rows, lifecycle.EVENT)
    actions = lifecycle.replay(log)
    got = {r.run: (r.phase, r.intents, r.frozen, r.close_reason) for r in lifecycle.summary(actions).collect()}
    assert got == {name: expected for name, (_, expected) in SCENARIOS.items()}
    for k in range(3):
        log.where((F.col("seq") >= 3 * k) & (F.col("seq") < (3 * k + 3 if k < 2 else 99))).coalesce(1).write.parquet(str(tmp_path / "log" / str(k)))
    stream = spark.readStream.schema(lifecycle.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "log" / "*"))
    live.run_available(lifecycle.replay_stream(stream, timers=False), str(tmp_path / "out"), str(tmp_path / "check"))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, actions.collect()))


def test_a_silent_run_freezes_by_the_clock(spark, tmp_path):
    """The order of run `lost` is never acknowledged and no event of it follows: a timer notices in a later batch."""
    rows = [event("lost", k, mono, kind, **more) for k, (kind, mono, more) in enumerate(OPENED[:3])]
    spark.createDataFrame(rows, lifecycle.EVENT).coalesce(1).write.parquet(str(tmp_path / "log" / "0"))
    for k in (1, 2):
        later = spark.createDataFrame([event(f"other{k}", 0, 0, "quote")], lifecycle.EVENT)
        later.coalesce(1).write.parquet(str(tmp_path / "log" / str(k)))
    stream = spark.readStream.schema(lifecycle.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))
    rows = lifecycle.replay_stream(stream, lifecycle.Lifecycle(ack=0.001))
    out = str(tmp_path / "out")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
    found, until = set(), time.monotonic() + 90
    while "no acknowledgement" not in {reason for _, reason in found} and time.monotonic() < until and query.isActive:
        time.sleep(1)
        if (tmp_path / "out" / "_spark_metadata").exists():
            found = {(r.action, r.reason) for r in spark.read.schema(lifecycle.ACTION).parquet(out).where("run = 'lost'").collect()}
    query.stop()
    assert found >= {("open_intent", "triggered"), ("freeze", "no acknowledgement")}


def test_limits_that_are_due(spark):
    rules_of = lifecycle.Lifecycle()
    state = dict(lifecycle.START)
    assert rules_of.due(state) is None
    state |= {"phase": "open_pending", "sent_at": 10.0, "mono": 11.0}
    assert rules_of.due(state) == 2.0
    assert rules_of.due(state | {"status": "3"}) == 9.0 and rules_of.due(state | {"status": "3", "cancel_at": 20.0, "mono": 21.0}) == 4.0
    assert rules_of.due(state | {"status": "0"}) == 4.0 and rules_of.due(state | {"frozen": "x"}) is None
    assert rules_of.due(state | {"phase": "holding", "filled_at": 5.0}) == 54.0


READY = {
    "connected": True, "settled": True, "frozen": False, "status": "2", "seconds_left": 900.0, "has_contract": True, "has_quote": True, "threshold": 1000.0, "expires": "e", "deadline": 100.0, "now": 50.0,
    "preflight": True, "snapshot_age": 5.0, "exchange": "SHFE", "product": "au", "product_class": "1", "tradable": True, "multiplier": 10.0, "open_positions": 0, "working_orders": 0, "currency": "CNY",
    "balance": 1e7, "available": 1e7, "max_loss": 500.0, "estimated_margin": 15_400.0, "fee_reserve": 4.0,
}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, ""), ({"connected": False}, "connection_or_settlement_not_ready"), ({"settled": False, "frozen": True}, "connection_or_settlement_not_ready"), ({"frozen": True, "status": "1"}, "manual_review_required"),
        ({"status": "1"}, "not_continuous_trading"), ({"seconds_left": 119.0}, "less_than_120_seconds_to_break"), ({"has_contract": False}, "missing_contract"), ({"has_quote": False, "bid": 0.0}, "missing_quote"),
        ({"bid": 1002.0, "threshold": 1.0}, "crossed_book"), ({"threshold": 1000.5}, "threshold_outside_limits_or_tick"), ({"threshold": 1101.0}, "threshold_outside_limits_or_tick"), ({"expires": "a"}, "expired_contract"),
        ({"now": 101.0}, "approved_parameters_expired"), ({"preflight": False}, "preflight_queries_incomplete"), ({"snapshot_age": 20.5}, "account_snapshot_stale"), ({"product": "cu"}, "unsupported_contract"),
        ({"open_positions": 1}, "existing_position_or_frozen"), ({"working_orders": 1}, "existing_working_order"), ({"currency": "USD"}, "wrong_currency"), ({"balance": 100_000.0}, "margin_exceeds_10_percent_equity"),
        ({"available": 18_900.0}, "insufficient_available"), ({"max_loss": 20.0}, "loss_budget_below_cost_buffer"), ({"estimated_margin": None}, "incomplete_risk_data"), ({"preflight": None}, "risk_rates_or_funds_missing"),
    ],
)
def test_ready_reasons(spark, change, reason):
    row = QUOTE | READY | change
    kinds = {str: "string", bool: "boolean", int: "int", float: "double"}
    schema = ", ".join(f"{n} {kinds[type((QUOTE | READY)[n])]}" for n in row)
    assert spark.createDataFrame([tuple(row.values())], schema).select(rules.ready_reason().alias("r")).first().r == reason


def test_exit_reasons(spark):
    rows = [(10.0, 0.0, False, 900.0, ""), (9.0, 70.0, True, 9.0, "stop_loss"), (10.0, 60.0, True, 9.0, "time_limit"), (10.0, 59.9, True, 9.0, "user_stop"), (10.0, 0.0, False, 29.9, "session_ending"), (10.0, 0.0, False, 30.0, "")]
    frame = spark.createDataFrame(rows, "bid double, held_seconds double, stop_requested boolean, seconds_left double, wanted string").withColumn("stop_price", F.lit(9.0))
    assert all(r.got == r.wanted for r in frame.select("wanted", rules.exit_reason().alias("got")).collect())


def parts(spark, tmp_path, count=3):
    rows = ticks.ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    edges = [int(r) for r in rows.approxQuantile("seq", [i / count for i in range(1, count)], 0.0)]
    for k, (a, b) in enumerate(zip([-1, *edges], [*edges, 10**9])):
        rows.where((F.col("seq") > a) & (F.col("seq") <= b)).select(*[f.split()[0] for f in live.TICK.split(", ")]).coalesce(1).write.parquet(str(tmp_path / "ticks" / str(k)))
    return rows, live.tick_stream(spark, str(tmp_path / "ticks" / "*"))


def test_stream_stats_and_crossings_equal_batch(spark, tmp_path):
    rows, stream = parts(spark, tmp_path)
    last = {}

    def collect(batch, number):
        last.update({r.symbol: (r.ticks, r.changes, r.volume, r.last_price) for r in batch.collect()})

    live.running_stats(stream).writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert last == {r.symbol: (r.ticks, r.changes, r.volume, r.last_price) for r in ticks.running_stats(rows).collect()}
    live.run_available(live.crossings(stream, 50.0), str(tmp_path / "crossed"), str(tmp_path / "c2"))
    got = {(r.symbol, r.seq) for r in spark.read.parquet(str(tmp_path / "crossed")).collect()}
    assert got == {(r.symbol, r.seq) for r in ticks.crossings(rows, F.lit(50.0)).collect()} and got
    ready = F.col("detail") % 7 != 0
    live.run_available(live.crossings(stream.withColumn("ready", ready), 50.0), str(tmp_path / "gated"), str(tmp_path / "c3"))
    gated = {(r.symbol, r.seq) for r in spark.read.parquet(str(tmp_path / "gated")).collect()}
    assert gated == {(r.symbol, r.seq) for r in ticks.crossings(rows, F.lit(50.0), ready).collect()} and gated < got
    live.event_sink(stream, str(tmp_path / "events"), str(tmp_path / "c4"), ["click", "view"])
    assert spark.read.json(str(tmp_path / "events")).count() == rows.where("event_type IN ('click', 'view')").count()


def test_stream_bars_close_behind_the_watermark(spark, tmp_path):
    _, stream = parts(spark, tmp_path, count=2)
    live.run_available(live.bars(stream, "1 hour"), str(tmp_path / "bars"), str(tmp_path / "c"))
    streamed = {(r.product, r.start): r.ticks for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    whole = {(r.product, r.start): r.ticks for r in ticks.minute_bars(ticks.ticks(spark, SF)).collect()}
    assert streamed and all(n <= whole[key] for key, n in streamed.items())  # late ticks are left out


def test_stream_fills_and_journal(spark, tmp_path):
    fills = ticks.fills(spark, SF).withColumn("reported", F.lit("2024-01-01").cast("timestamp")).select("exchange", "trading_day", "trade_id", "quantity", "amount", "reported")
    for k in range(2):
        fills.coalesce(1).write.parquet(str(tmp_path / "fills" / str(k)))
    stream = spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "fills" / "*"))
    live.run_available(live.distinct_fills(stream), str(tmp_path / "distinct"), str(tmp_path / "c1"))
    expected = ticks.distinct_fills(ticks.fills(spark, SF)).count()
    assert spark.read.parquet(str(tmp_path / "distinct")).count() == expected
    keys, journal = ["exchange", "trading_day", "trade_id"], str(tmp_path / "journal")
    writer = live.insert_once(journal, keys)
    stream.where("trade_id IS NOT NULL").writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(journal).count() == expected


def test_sources(spark, tmp_path):
    payload = 'var _x=([{"d":"2020-01-02","o":"1.5","h":"2","l":"1","c":"1.7","v":"10","p":"5","s":"1.6"},{"d":"2020-01-03","o":"","h":"2","l":"1","c":"1","v":"1","p":"1","s":"1"}]);'
    got = files.bars_of_payload(spark.createDataFrame([(payload,)], "value string")).collect()
    assert (got[0].open, got[0].open_interest, got[1].open) == (1.5, 5.0, None)
    raw = spark.createDataFrame([("2020-01-02", "A", "1", "", "1", ""), ("2020-01-03", "A", "1", "2", "1", "")], "date string, code string, open string, close string, tradestatus string, isST string")
    assert [r.close for r in files.parsed_bars(raw).collect()] == [None, 2.0]
    assert [(r.close, r.is_st) for r in files.parsed_bars(raw, drop_incomplete=True).collect()] == [(2.0, -1)]
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("see [b](sub/b.md#x) [c](gone.md) [w](https://x.y)\n```\n[no](no.md)\n```\n")
    (tmp_path / "docs" / "sub" / "b.md").write_bytes(b"hello")
    pages = files.markdown(spark, str(tmp_path / "docs"))
    found = files.links(pages, "path", "text")
    assert {r.target for r in found.collect()} == {"sub/b.md#x", "gone.md"}
    known = spark.createDataFrame([("sub/b.md",)], "file string")
    assert [r.file for r in files.broken_links(found, known).collect()] == ["gone.md"]
    import hashlib

    mark = {r.file: r for r in files.binary_manifest(spark, str(tmp_path / "docs")).collect()}["b.md"]
    assert (mark.bytes, mark.sha256, mark.blob_sha1) == (5, hashlib.sha256(b"hello").hexdigest(), hashlib.sha1(b"blob 5\0hello").hexdigest())
    pinned = spark.createDataFrame([("b.md", "x"), ("z.md", "y")], "file string, sha256 string")
    assert {r.file for r in files.drifted(files.binary_manifest(spark, str(tmp_path / "docs")), pinned, "file").collect()} == {"a.md", "b.md", "z.md"}
    parts_of = spark.createDataFrame([("2020-01-06", [["2020-01-05", "sh.1", "one"], ["2020-01-05", "sz.2", "two"]])], "asof string, rows array<array<string>>")
    assert [(r.asof_date, r.update_date, r.code, r.code_name) for r in files.exploded_parts(parts_of).collect()] == [("2020-01-06", "2020-01-05", "sh.1", "one"), ("2020-01-06", "2020-01-05", "sz.2", "two")]
    report = spark.createDataFrame([("f", 0.0123), ("g", float("nan"))], "name string, edge double")
    with pytest.raises(ValueError):
        files.write_once(report, str(tmp_path / "r"))
    files.write_once(report.limit(1), str(tmp_path / "r"))
    with pytest.raises(Exception, match="exist"):
        files.write_once(report.limit(1), str(tmp_path / "r"))
    assert files.report_lines(report.limit(1), "name", ["edge"]).first().line == "| f | +0.012 |"


def test_csv_series_and_plans(spark, tmp_path):
    head = "date,open,high,low,close,volume,open_interest,settlement\n"
    (tmp_path / "good.csv").write_text(head + "".join(f"2020-01-{d:02},1,2,1,2,9,9,2\n" for d in range(1, 21)))
    (tmp_path / "bad.csv").write_text(head + "2020-01-01,1,x,1,2,9,9,2\n")
    series = files.csv_bars(spark, str(tmp_path / "good.csv"))
    assert files.checked_series(series, least=20).count() == 20
    for broken in (series.limit(19), series.unionByName(series.limit(1)), series.withColumn("low", F.lit(0.0))):
        with pytest.raises(ValueError):
            files.checked_series(broken, least=20)
    with pytest.raises(Exception, match="MALFORMED|malformed|CAST_INVALID"):
        files.csv_bars(spark, str(tmp_path / "bad.csv")).collect()
    files.write_csv(series, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 20
    plan = {"symbols": ["a", "b"], "seconds": 5, "select": 2}
    assert files.checked_plan(plan) == plan
    for wrong in ({"symbols": []}, {"symbols": ["a", "a"]}, {"symbols": ["a", " b"]}, {"seconds": 0}, {"seconds": True}, {"select": 3}, {"select": float("nan")}, {"other": 1}):
        with pytest.raises(ValueError):
            files.checked_plan(plan | wrong)


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        files.published(spark, path)
    files.publish(spark.range(3), path)
    old = files.published(spark, path)
    with pytest.raises(Exception):  # a job that fails leaves the old version in place
        files.publish(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert files.published(spark, path).count() == 3
    files.publish(spark.range(5), path, files=1)
    assert files.published(spark, path).count() == 5 and old.count() == 3
