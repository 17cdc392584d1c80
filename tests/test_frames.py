"""Long frames made of shorter ones against frames of their own length."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import rolling
from ridgeline.plans import features

BAR = "vt_symbol string, day date, open double, high double, low double, close double, volume double, tradestatus int"


def test_long_frames_are_those_of_their_length(spark):
    rng, data = random.Random(4), []
    for name in ("gaps", "still", "moving"):
        for k in range(200):
            close = {"still": 8.0, "gaps": None if k == 90 else rng.random() + 1}.get(name, rng.random() + 1)
            data.append((name, date(2024, 1, 1) + timedelta(k), close, close, close, close, 1.0, 1))
    panel = features.panel(spark.createDataFrame(data, BAR))
    text = panel.select("ma120", "sd40")._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -119" not in text and "RowFrame, -39" not in text  # before, Spark added each of them up at every row
    plain = {f"plain_ma{n}": rolling(F.avg, "close", n) for n in (20, 40, 60, 120)} | {f"plain_sd{n}": rolling(F.stddev_samp, "day_return", n) for n in (10, 20, 40)}
    rows = panel.withColumns(plain).collect()
    for r in rows:
        for name in plain:
            got, want = r[name.removeprefix("plain_")], r[name]
            assert got == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-15)), (r.vt_symbol, r.day, name)
    assert {r.sd40 for r in rows if r.vt_symbol == "still"} == {None, 0.0} and sum(r.ma120 is not None for r in rows) > 80


def test_extremes_are_made_of_shorter_frames(spark):
    """Before, the largest of 60 rows looked at 60 rows for each row."""
    rng = random.Random(8)
    rows = [(f"S{k % 3}", k // 3, rng.choice([None, float("nan")]) if rng.random() < 0.01 else rng.gauss(0, 1)) for k in range(900)]
    bars = spark.createDataFrame(rows, "vt_symbol string, day int, x double").repartition(4)
    stage = {f"{how}{n}_{ending}": features.roll(how, "x", n, ending) for how in ("max", "min") for n in (5, 10, 14, 20, 60) for ending in (0, 1)}
    got = features.panel(bars, [stage])
    plain = bars.withColumns({name: features.rolling(features.AGGREGATES[how], "x", n, ending) for name, (_, how, _, n, ending) in stage.items()})
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert "-59" not in got._jdf.queryExecution().optimizedPlan().toString()
