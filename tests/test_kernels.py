"""Ranks in one sort, bootstrap intervals and reselection against plain Python."""

import hashlib
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import average_rank, ordered_ranks
from ridgeline.plans import bootstrap, screens, studies


def test_places_and_ranks_share_an_order(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k % 3, f"S{k}", float(rng.randrange(6))) for k in range(200)], "g int, name string, x double").repartition(5)
    got = ordered_ranks(rows, "x", ["g"], "name", "place", "rank").withColumn("plain", average_rank("x", "g")).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (-r.x, r.name))
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert {r.rank - r.plain for r in mine} == {-len(mine) - 1.0}  # the same ranks, moved by a constant


@pytest.mark.parametrize("days, block", [(23, 4), (8, 4), (7, 4), (40, 10), (41, 1)])
def test_intervals_are_those_of_the_drawn_days(spark, days, block):
    rng = random.Random(days)
    values = [rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(days)]
    first = date(2024, 1, 1)
    series = spark.createDataFrame([("k", first + timedelta(i), v) for i, v in enumerate(values)], "era string, day date, value double").repartition(3)
    got = bootstrap.intervals(series, block, 7, replicates=300).collect()
    if days < 2 * block:
        assert got == []
        return
    means = []
    for r in range(300):
        drawn = []
        for b in range(-(-days // block)):
            start = int(hashlib.md5(f"7:{r}:{b}".encode()).hexdigest()[:8], 16) % days
            drawn += [values[(start + i) % days] for i in range(block)]
        seen = [v for v in drawn[:days] if v is not None]
        means.append(np.mean(seen) if seen else np.nan)
    known = np.array(means)[np.isfinite(means)]
    assert got[0].replicates == len(known)
    assert np.allclose([got[0].low, got[0].high], np.quantile(known, [0.025, 0.975]))


def test_net_intervals_count_days_without_a_signal(spark):
    days = [date(2024, 1, 1) + timedelta(k) for k in range(20)]
    grid = spark.createDataFrame([("a", d) for d in days] + [("b", d) for d in days[:5]], "era string, day date")
    daily = spark.createDataFrame([("a", d, 0.01, 0.002) for d in days[::2]] + [("b", days[0], 0.5, 0.5)], "era string, day date, signal_mean double, edge double")
    got = {r.era: r for r in studies.net_intervals(daily, grid, 4, 1).collect()}
    assert (got["a"].grid_dates, got["a"].signal_dates) == (20, 10) and got["a"].net_low == pytest.approx(0.007) and got["a"].block_edge_high == pytest.approx(0.002)
    assert (got["b"].grid_dates, got["b"].signal_dates, got["b"].net_low) == (5, 1, None)


def test_each_variant_has_its_own_selection(spark):
    eras = list(screens.SCREENS["clean"])
    row = lambda v, f, mean, edge, days=70: [(v, f, era, days, 900, mean, edge, 0.05, days) for era in eras]
    rows = row("free", "x", 0.01, 0.01) + row("free", "y", 0.02, 0.01) + row("clipped", "x", 0.01, 0.01) + row("clipped", "y", 0.002, 0.01) + row("thin", "z", 0.01, 0.01, days=5)
    summary = spark.createDataFrame(rows, "variant string, factor string, era string, days int, signals int, signal_mean double, edge double, rank_ic double, rank_ic_days int")
    got = {r.variant: (r.factor, r.pool, r.pool_size) for r in screens.selected_of_each(summary, screens.SCREENS["clean"], "variant").collect()}
    assert got == {"free": ("y", 1, 2), "clipped": ("x", 1, 1)}
    assert screens.selected(summary.where(F.col("variant") == "free"), screens.SCREENS["clean"]).first().factor == "y"
