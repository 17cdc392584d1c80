"""Assembled answers, discovery, heartbeats and the journal as streams, against their batch forms."""

import time

import pytest
from pyspark.sql import functions as F

from ridgeline.streaming import answers, discovery, journal, live, ticks

SF = "/root/testdata/sf0.001"


def ran(query, rows):
    """Waits till a query has taken so many rows in: with timers its batches go on, with or without rows."""
    until(query, lambda: sum(p["numInputRows"] for p in query.recentProgress) >= rows)


def drained(stream, tmp_path, name, rows):
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
    ran(query.trigger(processingTime="500 milliseconds").start(), rows)
    return out


def until(query, found, seconds=90):
    """Waits till found() holds or the query stops; then stops the query."""
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end and query.isActive and not found():
            time.sleep(0.3)
    finally:
        query.stop()
    assert found()


def message_files(spark, tmp_path, rows, schema, cuts):
    for k, part in enumerate(cuts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(str(tmp_path / "messages" / str(k)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "messages" / "*"))


def test_assembled_answers_equal_the_batch_form(spark, tmp_path):
    messages = ticks.responses(spark, SF).withColumnRenamed("l_linenumber", "place").persist()
    # In order of arrival every message before the last one of its request: the last ones come in a file of their own.
    late = tmp_path / "ordered"
    messages.where("NOT is_last").coalesce(1).write.parquet(str(late / "0"))
    messages.where("is_last").coalesce(1).write.parquet(str(late / "1"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(late / "*"))
    got = spark.read.parquet(drained(answers.assembled(stream), tmp_path, "whole", messages.count()))
    key = lambda r: (r.request_id, r.place, r.l_partkey, r.rows)
    assert sorted(map(key, got.collect())) == sorted(map(key, answers.counted(messages).collect()))
    whole = got.groupBy("request_id").agg(F.count("*").alias("rows"), F.sum("l_partkey").alias("checksum"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ticks.assembled(ticks.responses(spark, SF)).collect())) and whole.count() > 100
    messages.unpersist()


def test_answers_replace_their_table_and_stray_messages_wait(spark, tmp_path):
    schema = "request_id long, place long, is_last boolean, table string, code string, amount double"
    rows = [
        (1, 1, False, "position", "au", 1.0), (1, 2, False, "position", "ag", 2.0), (1, 3, True, "position", None, None), (2, 1, True, "account", "CNY", None),
        (3, 1, False, "position", "cu", 5.0), (1, 4, False, "position", "stray", 9.0), (3, 2, True, "position", "zn", 6.0), (4, 1, False, "account", "USD", 1.0),
    ]
    stream = message_files(spark, tmp_path, rows, schema, [[0], [1, 2, 3], [4, 5], [6, 7]])
    path = str(tmp_path / "tables")
    write = journal.merging(path, ["table"])
    query = answers.assembled(stream).writeStream.foreachBatch(lambda batch, n: write(answers.latest_answers(batch), n))
    ran(query.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start(), len(rows))
    kind = schema + ", rows long"
    now = {(r.table, r.request_id, r.code, r.amount, r.rows) for r in journal.journal(spark, path, kind).collect()}
    assert now == {("position", 3, "cu", 5.0, 2), ("position", 3, "zn", 6.0, 2), ("account", 2, "CNY", None, 1)}
    before = {(r.table, r.code) for r in journal.journal(spark, path, kind, as_of=1).collect()}
    assert before == {("position", "au"), ("position", "ag"), ("position", None), ("account", "CNY")}


def test_messages_that_wait_too_long_expire(spark, tmp_path):
    schema = "request_id long, place long, is_last boolean"
    stream = message_files(spark, tmp_path, [(1, 1, False), (1, 2, True)], schema, [[0], [1]])
    got = spark.read.parquet(drained(answers.assembled(stream, ttl_seconds=0.001), tmp_path, "late", 2)).collect()
    assert [(r.place, r.rows) for r in got] == [(2, 1)]


def tick_files(spark, tmp_path, parts):
    for k, rows in enumerate(parts):
        rows.select(*[f.split()[0] for f in live.TICK.split(", ")]).coalesce(1).write.parquet(str(tmp_path / "ticks" / str(k)))
    return live.tick_stream(spark, str(tmp_path / "ticks" / "*"), files_per_batch=10)


def test_discovery_selects_what_the_batch_form_does(spark, tmp_path):
    rows = ticks.ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = tick_files(spark, tmp_path, [rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")])
    found = []
    query = discovery.discovered(stream, seconds=0.5).writeStream.foreachBatch(lambda b, n: found.extend(map(tuple, b.select("product", "symbol", "volume", "ticks").collect())))
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    wanted = sorted((r["product"], r.symbol, r.volume, r.ticks) for r in ticks.most_active(ticks.running_stats(rows)).collect())
    until(query, lambda: len(found) >= len(wanted))
    assert sorted(found) == wanted


def test_discovery_waits_for_a_product_without_life(spark, tmp_path):
    at = "timestamp'2024-01-01'"
    one = spark.range(6).selectExpr("id % 2 AS symbol", "0L AS product", f"{at} AS ts", "id AS seq", "CAST(10 + id AS double) AS price", "id AS volume", "1 AS detail", "'t' AS event_type")
    lone = spark.range(1).selectExpr("7L AS symbol", "1L AS product", f"{at} AS ts", "100L AS seq", "5.0D AS price", "1L AS volume", "1 AS detail", "'t' AS event_type")
    stream = tick_files(spark, tmp_path, [one, lone])
    found, named = {}, []

    def select(batch, number):
        for r in batch.collect():
            found[r["product"]] = r
            if r["product"] == 0:
                lone.selectExpr("symbol", "product", "ts", "101L AS seq", "6.0D AS price", "2L AS volume", "detail", "event_type").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ticks" / "2"))

    query = discovery.discovered(stream, seconds=0.3).writeStream.foreachBatch(select).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    until(query, lambda: len(found) == 2)
    assert (found[0].symbol, found[0].windows) == (1, 1) and (found[1].symbol, found[1].ticks) == (7, 2) and found[1].windows > 1
    query = discovery.discovered(stream, seconds=0.3, explicit=[0, 7]).writeStream.foreachBatch(lambda b, n: named.extend(r.symbol for r in b.collect()))
    until(query.option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="100 milliseconds").start(), lambda: len(named) >= 2)
    assert sorted(named) == [0, 7]


def test_heartbeats_need_no_rows(spark, tmp_path):
    rows = ticks.ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    beats = []
    query = discovery.heartbeats(tick_files(spark, tmp_path, [rows]), seconds=0.2, shards=2).writeStream.foreachBatch(lambda b, n: beats.extend(b.collect()))
    until(query.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start(), lambda: {r.shard for r in beats if r.beat >= 3} == {0, 1})
    assert {sum(r.ticks for r in beats if r.beat == k) for k in (1, 2, 3)} == {rows.count()}


ROW = "key string, at long, payload string"


def test_journal_merges_and_runs_again(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    held = lambda path, **more: sorted(map(tuple, journal.journal(spark, path, ROW, **more).collect()), key=str)
    path = str(tmp_path / "replace")
    write = journal.merging(path, ["key"], order=["at"], buckets=4)
    assert held(path) == []
    write(frame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), *[(f"k{i}", 0, "0") for i in range(20)]]), 0)
    write(frame([("a", 3, "z"), (None, 5, "m")]), 1)
    after = held(path)
    assert ("a", 3, "z") in after and (None, 5, "m") in after and len(after) == 22 and ("a", 2, "y") in held(path, as_of=0)
    write(frame([("a", 3, "z"), (None, 5, "m")]), 1)  # the same batch again
    assert held(path) == after
    assert len(list((tmp_path / "replace" / "data" / "batch=1").glob("bucket=*"))) <= 2  # only the buckets of its keys
    write(frame([]), 2)
    assert held(path) == after
    path = str(tmp_path / "ignore")
    write = journal.merging(path, ["key"], when="ignore", order=["at"], buckets=4)
    write(frame([("a", 2, "y"), ("a", 1, "x")]), 0)
    write(frame([("a", 0, "w"), ("b", 0, "v")]), 1)
    assert held(path) == [("a", 1, "x"), ("b", 0, "v")]
    path = str(tmp_path / "refuse")
    write = journal.merging(path, ["key"], when="refuse", buckets=4)
    write(frame([("open", 1, "x")]), 0)
    for rows in ([("open", 2, "y")], [("close", 1, "x"), ("close", 2, "x")]):
        with pytest.raises(ValueError):
            write(frame(rows), 1)
    write(frame([("close", 1, "x")]), 1)
    assert [r[0] for r in held(path)] == ["close", "open"]
    with pytest.raises(ValueError):
        journal.merging(path, ["key"], when="other")


def test_a_batch_that_failed_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "j")
    write = journal.merging(path, ["key"], buckets=2)
    write(spark.createDataFrame([("a", 1, "x")], ROW), 0)
    broken = spark.createDataFrame([("a", 2, "y")], ROW).withColumn("payload", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception):
        write(broken, 1)
    assert [tuple(r) for r in journal.journal(spark, path, ROW).collect()] == [("a", 1, "x")]
