"""The provider source and Arrow streams, on tables derived from the sales."""

import datetime
import json
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import bars as B
from ridgeline.sources import arrow, provider

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def payloads(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("provider") / "bars")
    provider.write_payloads(B.weekly_bars(spark, SF), path)
    provider.register(spark)
    return path


def read(spark, path, **options):
    return spark.read.format("provider_bars").options(path=path, **options).load()


def test_provider_bars_come_back(spark, payloads):
    got = read(spark, payloads)
    wanted = B.weekly_bars(spark, SF)
    columns = ["vt_symbol", "day", "open", "high", "low", "close", "volume", "tradestatus", "is_st"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
    assert got.rdd.getNumPartitions() == wanted.select("vt_symbol").distinct().count()  # one for each symbol
    few = read(spark, payloads, together="4")
    assert few.rdd.getNumPartitions() == -(-got.rdd.getNumPartitions() // 4) and few.count() == got.count()
    assert got.where("amount IS NOT NULL").count() == 0  # missing at the provider


def test_provider_filters_narrow_what_is_read(spark, payloads):
    got = read(spark, payloads, least="1").where("day >= DATE '1998-01-05' AND day < DATE '1999-01-04' AND vt_symbol IN ('S1', 'S2')")
    assert got.rdd.getNumPartitions() == 2
    wanted = B.weekly_bars(spark, SF).where("day >= DATE '1998-01-05' AND day < DATE '1999-01-04' AND vt_symbol IN ('S1', 'S2')")
    assert {(r.vt_symbol, r.day) for r in got.collect()} == {(r.vt_symbol, r.day) for r in wanted.collect()} != set()
    with pytest.raises(Exception, match="only"):
        read(spark, payloads).where("day >= DATE '2001-10-01'").collect()


def row(day, code="X", close="1.5", st="0"):
    return [day, code, "1", "2", "1", close, "1", "10", "", "", "1", "", st]


def test_provider_checks(spark, payloads, tmp_path):
    def written(name, rows):
        folder = tmp_path / name / "code=X"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text("".join(json.dumps({"fields": r}) + "\n" for r in rows))
        return str(tmp_path / name)

    days = [str(datetime.date(2024, 1, 1) + datetime.timedelta(k)) for k in range(60)]
    good = written("good", [row(d) for d in days])
    assert read(spark, good).count() == 60
    with pytest.raises(Exception, match="only 59 rows"):
        read(spark, good, begin=days[1]).count()
    for name, rows, message in (("twice", [row(d) for d in [*days, days[3]]], "duplicate dates"), ("other", [row(d, code="Y") for d in days], "unexpected bar row"), ("short", [row(days[0])[:9]], "unexpected bar row")):
        with pytest.raises(Exception, match=message):
            read(spark, written(name, rows), least="1").count()
    gaps = written("gaps", [[*row(days[0])[:6], "1", "10", "5", "5", "1", "2", ""], row(days[1], close="")])
    got = read(spark, gaps, least="1").orderBy("day").collect()
    assert (got[0].is_st, got[1].close, got[1].turn) == (None, None, None)
    got = read(spark, gaps, least="1", complete="true").collect()
    assert [(str(r.day), r.is_st) for r in got] == [(days[0], -1)]
    assert read(spark, good, codes=json.dumps(["X"]), end=days[-1]).count() == 60


def test_arrow_streams_come_back(spark):
    arrow.shipped(spark)
    bars = B.weekly_bars(spark, SF)
    back = arrow.decoded(arrow.encoded(bars), "stream", bars.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, bars.collect()))
    with pytest.raises(Exception, match="no column other"):
        arrow.decoded(arrow.encoded(bars), "stream", "other long").collect()


class Trap:
    def __reduce__(self):
        return (exec, ("raise SystemExit('ran')",))


def test_arrow_cache_files(spark, tmp_path):
    arrow.shipped(spark)
    table = pa.table({"datetime": pa.array([datetime.datetime(2024, 1, 1), None], pa.timestamp("us")), "close": [1.5, None], "vt_symbol": pa.array(["A", "B"], pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=1)
    content = sink.getvalue().to_pybytes()
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.arrow").write_bytes(content)
    (tmp_path / "plain" / "b.arrow").write_bytes(content)
    got = arrow.arrow_cache(spark, str(tmp_path / "plain"))
    assert got.dtypes == [("datetime", "timestamp_ntz"), ("close", "double"), ("vt_symbol", "string")] and got.count() == 4
    (tmp_path / "held").mkdir()
    (tmp_path / "held" / "a.pkl").write_bytes(pickle.dumps({"trap": Trap(), "frame": content}))
    held = arrow.arrow_cache(spark, str(tmp_path / "held"), pickled=True)
    assert sorted(map(str, held.collect())) == sorted(map(str, got.distinct().collect()))
    (tmp_path / "held" / "b.pkl").write_bytes(pickle.dumps([content, content[:40]]))
    with pytest.raises(Exception, match="one byte string"):
        arrow.arrow_cache(spark, str(tmp_path / "held"), held.schema, pickled=True).count()
    with pytest.raises(FileNotFoundError):
        arrow.arrow_cache(spark, str(tmp_path / "plain"), glob="*.none")


def test_membership_lists(spark):
    frame = spark.createDataFrame([("A", [(datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)), (datetime.date(2020, 3, 1), datetime.date(2020, 3, 1))]), ("B", [])], "vt_symbol string, spans array<struct<start:date,end:date>>")
    assert arrow.membership(frame).count() == 2
    wrong = frame.withColumn("spans", F.array(F.struct(F.lit("2020-02-01").cast("date").alias("start"), F.lit("2020-01-01").cast("date").alias("end"))))
    with pytest.raises(Exception, match="no interval of"):
        arrow.membership(wrong).collect()


def test_many_symbols_share_a_task(spark):
    """Before, each symbol had a task of its own, so the registered query had as many tasks as symbols."""
    import __spark_entry__

    rows = __spark_entry__.queries()["provider_bars"](spark, SF)
    symbols = rows.select("vt_symbol").distinct().count()
    assert 1 < symbols and rows.rdd.getNumPartitions() <= -(-symbols // provider.TOGETHER)
