"""Envelopes, routing and attribution of events, in batches and streams."""

from datetime import datetime

from pyspark.sql import functions as F

from ridgeline.streaming import live, routing, ticks

SF = "/root/testdata/sf0.001"


def test_owners_of_reports(spark):
    intents = spark.createDataFrame([("open", "au", "1", 5, 9, None), ("close", "au", "2", 5, 9, "S2")], "role string, instrument string, order_ref string, front int, session int, sys_id string")
    cases = [
        (("au", "1", None, None, None), "open"), (("au", "1", 5, 9, "x"), "open"), (("au", "1", 6, 9, None), None), (("au", "1", 5, 8, None), None), (("au", "1", 5, None, None), None),
        (("ag", "1", 5, 9, None), None), (("au", "3", 5, 9, None), None), (("au", "2", 5, 9, "S2"), "close"), (("au", "2", 5, 9, None), None), (("au", "2", None, 1, "S2"), "close"), ((None, "1", None, None, None), None),
    ]
    reports = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "n int, instrument string, order_ref string, front int, session int, sys_id string")
    assert {r.n: r.role for r in routing.owners(reports, intents).collect()} == {k: role for k, (_, role) in enumerate(cases)}


def test_two_streams_are_routed_and_owned_like_batches(spark, tmp_path):
    market = ticks.ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).select("symbol", "ts", "price", F.lit("tick").alias("kind"))
    trading = ticks.responses(spark, SF).select("request_id", "l_partkey", F.lit("answer").alias("kind"))
    for name, rows in (("market", market), ("trading", trading)):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name, rows: spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    both = routing.one_stream(stream("market", market), stream("trading", trading))
    symbols, requests = market.where("symbol % 2 = 0").select("symbol"), trading.where("request_id % 3 = 0").select("request_id")
    live.run_available(routing.wanted(both, symbols, requests), str(tmp_path / "out"), str(tmp_path / "c"))
    wanted = routing.wanted(routing.one_stream(market, trading), symbols, requests)
    assert wanted.count() == market.where("symbol % 2 = 0").count() + trading.where("request_id % 3 = 0").count() > 0
    columns = ["kind", "symbol", "request_id", "l_partkey", "price"]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(str, wanted.select(columns).collect()))
    routing.console(stream("market", market).limit(3), str(tmp_path / "c2")).awaitTermination()


def test_envelopes_and_maps(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 1)), (2, None)], "n int, received_at timestamp")
    got = {r.n: r for r in routing.enveloped(rows, "tick").collect()}
    assert got[1].received_mono == 1704067201.0 and got[2].received_at is not None and got[2].kind == "tick"
    assert routing.enveloped(rows.drop("received_at"), "x").where("received_mono > 1.7e9").count() == 2
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "1"}), ({}, None)], "p map<string,string>, q map<string,string>")
    assert [r.m for r in maps.select(routing.merged_maps(F.col("p"), F.col("q")).alias("m")).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "1"}, {}]
    assert maps.select(routing.only_keys(F.col("p"), ["b", "z"]).alias("m")).first().m == {"b": "2"}


def test_verified_symbols_and_exit_codes(spark):
    stats = spark.createDataFrame([("a", 5, 2), ("b", 5, 0)], "symbol string, ticks long, changes long")
    chosen = lambda *names: routing.verified(spark.createDataFrame([(n,) for n in names], "symbol string"), stats)
    assert {r.symbol: r.verified for r in chosen("a", "a", "b", "z").collect()} == {"a": True, "b": False, "z": False}
    assert routing.exit_code(chosen("a")) == 0 and routing.exit_code(chosen("a", "b")) == 2 and routing.exit_code(chosen()) == 2
