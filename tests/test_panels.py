"""Panels, labels and protocols: the scenarios that a study must not get wrong."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import average_rank, correlation, ratio, rolling
from ridgeline.operators import bars as B
from ridgeline.operators import labels, quality
from ridgeline.plans import bootstrap, factors, features, screens, studies
from ridgeline.plans.ledger import StudyLedger

BAR = "vt_symbol string, day date, open double, high double, low double, close double, volume double, tradestatus int, is_st int"
FIRST = date(2020, 1, 1)


def panel_rows(symbol, n, price, skip=(), volume=lambda i: 1000.0):
    for i in range(n):
        if i not in skip:
            p = price(i)
            yield symbol, FIRST + timedelta(days=i), p - 0.03, p + 0.1, p - 0.1, p, volume(i), 1, 0


def test_missing_bars_stay_as_no_fill_and_open_position(spark):
    rise = lambda i: 100 + i / 10
    bars = spark.createDataFrame([*panel_rows("AAA", 90, rise, skip=(61, 72)), *panel_rows("BBB", 90, rise)], BAR)
    days = B.schedule(B.market_days(bars), str(FIRST + timedelta(days=60)), str(FIRST + timedelta(days=89)))
    rows = labels.keep_all(bars.join(days, "day"), bars).where("vt_symbol = 'AAA'")
    got = {(r.day - FIRST).days: r for r in rows.collect()}
    assert not got[60].entry_fill and got[60].intent_return == 0.0
    assert got[66].entry_fill and got[66].unclosed_at_horizon and got[66].worst_case_return == -1.0
    assert got[66].intent_return == pytest.approx(rise(71) / (rise(67) - 0.03) - 1)
    assert labels.keep_all(bars.join(days, "day"), bars).count() == 2 * days.count() - 1  # AAA has no signal on the day it misses


@pytest.mark.parametrize("study", ["stock", "followup", "clean", "unified", "price"])
def test_scores_do_not_see_the_future(spark, study):
    price = lambda i: 10 + 0.01 * i + 0.0005 * i * i + 0.2 * (i % 7)
    rows = list(panel_rows("AAA", 175, price, volume=lambda i: 10_000.0 + 1000 * (i % 5)))
    changed = [r if k < 170 else (*r[:2], *(x * 3 for x in r[2:6]), *r[6:]) for k, r in enumerate(rows)]
    tables = []
    for data in (rows, changed):
        members = studies.with_context(features.panel(spark.createDataFrame(data, BAR)))
        scored = studies.scores(members, study, digits=9).where(F.col("day") < F.lit(FIRST + timedelta(days=170)))
        tables.append(scored.orderBy("day").collect())
    assert tables[0] == tables[1]
    found = {n for n in factors.STUDIES[study] for r in tables[0] if r[n]}
    assert len(found) > len(factors.STUDIES[study]) / 3


def test_strict_rolling_and_guards(spark):
    frame = spark.createDataFrame([("A", FIRST + timedelta(days=i), x) for i, x in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "vt_symbol string, day date, x double")
    got = [r.m for r in frame.withColumn("m", rolling(F.avg, "x", 3)).orderBy("day").collect()]
    assert got == [None, None, None, None, None, 5.0]
    assert frame.select(ratio(F.lit(1.0), F.lit(0.0)).alias("r")).first().r is None
    ties = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    assert sorted((r.g, r.k) for r in ties.select("g", average_rank("x", "g").alias("k")).collect()) == [("a", 1.5), ("a", 1.5), ("a", 3.0), ("b", 1.0)]
    assert ties.agg(correlation(F.lit(1.0), "x").alias("c")).first().c is None


def test_as_of_takes_the_last_row_even_if_empty(spark):
    facts = spark.createDataFrame([("A", 1, 10.0), ("A", 5, None), ("B", 9, 1.0)], "k string, at int, v double")
    rows = spark.createDataFrame([("A", 0), ("A", 1), ("A", 4), ("A", 7), ("B", 3), ("C", 3)], "k string, t int")
    got = {(r.k, r.t): r.v for r in labels.as_of(rows, "t", facts, "at", "k", ["v"]).collect()}
    assert got == {("A", 0): None, ("A", 1): 10.0, ("A", 4): 10.0, ("A", 7): None, ("B", 3): None, ("C", 3): None}


def test_normalised_and_overlaps(spark):
    raw = spark.createDataFrame([("600000.SSE", "2020-01-02", 1.0, 1.0, 1.0, 1.0, 1.0)], "code string, date string, open double, high double, low double, close double, volume double")
    out = B.normalised(raw)
    assert out.first().tradestatus == 1 and out.select(B.exchange_code(F.col("vt_symbol")).alias("c")).first().c == "sh.600000"
    with pytest.raises(ValueError):
        B.normalised(raw.drop("close"))
    spans = spark.createDataFrame([("A", date(2020, 1, 1), date(2020, 2, 1)), ("A", date(2020, 2, 1), date(2020, 3, 1)), ("B", date(2020, 1, 1), date(2020, 1, 2))], "vt_symbol string, member_start date, member_end date")
    assert [r.vt_symbol for r in B.overlapping(spans).collect()] == ["A"]


def test_checks_of_snapshots_calendars_and_facts(spark):
    bars = spark.createDataFrame(list(panel_rows("A", 6, lambda i: 5.0)), BAR)
    days = bars.select("day").distinct()
    assert quality.checked_calendar(bars, days).count() == 6
    with pytest.raises(ValueError):
        quality.checked_calendar(bars, days.where(F.col("day") > F.lit(FIRST)))
    with pytest.raises(ValueError):
        quality.checked_calendar(bars.where(F.col("day") != F.lit(FIRST + timedelta(days=3))), days)
    members = spark.createDataFrame([(FIRST, "A"), (FIRST, "B"), (FIRST + timedelta(days=7), "A"), (FIRST + timedelta(days=7), "C")], "day date, vt_symbol string")
    assert quality.checked_members(members, 2, 2).count() == 4
    for broken, least in ((members, 3), (members.unionByName(members.limit(1)), 1), (members.limit(0), 0)):
        with pytest.raises(ValueError):
            quality.checked_members(broken, least, 9)
    assert {(r.vt_symbol, r.snapshots) for r in quality.union_of_members(members).collect()} == {("A", 2), ("B", 1), ("C", 1)}
    facts = spark.createDataFrame([("A", 1), ("B", 2)], "vt_symbol string, sector int")
    assert labels.attached(members.where("vt_symbol <> 'C'"), facts, ["vt_symbol"]).count() == 3
    for rows, side in ((members, facts), (members.where("vt_symbol = 'A'"), facts.unionByName(facts))):
        with pytest.raises(ValueError):
            labels.attached(rows, side, ["vt_symbol"])


def test_frozen_prices(spark):
    bars = spark.createDataFrame(list(panel_rows("A", 9, lambda i: float(max(i, 5) if i < 7 else 9))), BAR)
    assert [(r.first_day, r.bars) for r in quality.frozen_prices(bars).collect()] == [(FIRST, 6)]


def test_bootstrap_is_repeatable_and_meets_brute_force(spark):
    import hashlib

    import numpy as np

    rows = [("e", FIRST + timedelta(days=i), None if i % 4 == 1 else i * 0.37 % 1) for i in range(37)] + [("short", FIRST, 1.0)]
    series = spark.createDataFrame(rows, "era string, day date, value double")
    got = bootstrap.intervals(series, block=5, seed=3, replicates=200).collect()
    values = np.array([np.nan if v is None else v for e, _, v in rows if e == "e"])
    means = []
    for r in range(200):
        drawn = []
        for b in range(8):
            start = int(hashlib.md5(f"3:{r}:{b}".encode()).hexdigest()[:8], 16) % 37
            drawn += [values[(start + i) % 37] for i in range(5)]
        means.append(np.nanmean(drawn[:37]))
    assert [r.era for r in got] == ["e"]
    assert (got[0].low, got[0].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    twice = [bootstrap.seeded_intervals(series, block=5, seed=3, replicates=300).orderBy("era").collect() for _ in range(2)]
    assert twice[0] == twice[1]


SUMMARY = "factor string, era string, days long, signals long, signal_mean double, edge double, rank_ic double, rank_ic_days long, edge_low double, net_low double"


def test_screens_and_selection_pools(spark):
    eras = ("train", "valid", "old_dev", "new_dev")

    def rows(factor, days=70, signals=600, mean=0.01, edge=0.02, ic=0.02, last=None):
        made = [[factor, era, days, signals, mean, edge, float(ic), days, 0.001, 0.001] for era in eras]
        for place, value in (last or {}).items():
            made[3][place] = value
        return [tuple(r) for r in made]

    frame = lambda *parts: spark.createDataFrame([r for p in parts for r in p], SUMMARY)
    rules = screens.SCREENS["clean"]
    table = frame(rows("a", mean=0.011), rows("b", mean=0.012), rows("short", last={2: 29}), rows("edge", last={5: 0.0015}), rows("null", last={6: None}), rows("few", last={3: 499}), rows("three")[:3])
    assert {r.factor for r in screens.screened(table, rules).where("qualifies").collect()} == {"a", "b"}
    assert {r.factor: r.eras_met for r in screens.screened(table, rules).collect()}["three"] == 3
    first = screens.selected(table, rules).first()
    assert (first.factor, first.pool, first.pool_size) == ("b", 1, 2)
    second = frame(rows("x", ic=0.0, edge=0.001), rows("y", ic=0.0, edge=0.0005), rows("thin", days=19))
    assert tuple(screens.selected(second, rules).first())[:3] == ("x", 2, 2)  # equal gains: the larger edge
    third = frame(rows("p", mean=-0.1, edge=-0.2), rows("q", mean=-0.3, edge=-0.1), rows("thin", signals=299))
    assert tuple(screens.selected(third, rules).first())[:3] == ("q", 3, 2)
    assert screens.selected(frame(rows("thin", days=19)), rules).isEmpty()
    assert screens.selected(frame(rows("n"), rows("m")), rules).first().factor == "n"  # all equal: the last name
    for name in ("stock", "followup", "unified"):
        assert screens.screened(frame(rows("a")), screens.SCREENS[name]).first().qualifies
    assert not screens.screened(frame(rows("a", ic=0.01)), screens.SCREENS["followup"]).first().qualifies
    by_valid = lambda table, **how: tuple(screens.selected_by_validation(table, screens.SCREENS["followup"], **how).first() or ())[:2]
    assert by_valid(frame(rows("a"), rows("b", edge=0.03))) == ("b", 1)
    assert by_valid(frame(rows("a", ic=0))) == ("a", 2) and by_valid(frame(rows("a", edge=-0.1))) == ("a", 3)
    assert by_valid(frame(rows("a", ic=0)), fallback=False) == () and by_valid(frame(rows("a", days=59))) == ()


def test_ledger(spark, tmp_path):
    ledger = StudyLedger(spark, str(tmp_path / "ledger"))
    with pytest.raises(ValueError):
        ledger.round(1, {"x": 1})
    assert ledger.plan({"a": 1}) == ledger.plan({"a": 1})
    with pytest.raises(ValueError):
        ledger.plan({"a": 2})
    with pytest.raises(ValueError):
        ledger.round(2, {})
    ledger.round(1, {"x": 1})
    with pytest.raises(FileExistsError):
        ledger.round(1, {"x": 2})
    ledger.lock(1, {"best": "c"})
    with pytest.raises(ValueError):
        ledger.finalize({}, {"best": "d"})
    ledger.finalize({"edge": 1.0}, {"best": "c"})
    with pytest.raises(FileExistsError):
        ledger.finalize({"edge": 1.0}, {"best": "c"})
