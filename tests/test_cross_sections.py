"""Kernels over cross-sections against plain Python, and what a study shuffles."""

import random
import re
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from ridgeline.operators import bars as B
from ridgeline.operators import labels
from ridgeline.plans import evaluate, features, studies

ROW = "day date, exit_day date, vt_symbol string, era string, intent_return double, worst_case_return double, entry_fill boolean, unclosed_at_horizon boolean, f_a double, f_b double, f_c double"


def average_ranks(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def rows(seed=5, count=160):
    rng = random.Random(seed)
    out = []
    for k in range(count):
        day = date(2024, 1, 1 + k % 3)
        intent = rng.choice([None, rng.gauss(0, 1), round(rng.gauss(0, 1), 1)])
        scores = rng.choice([None, 0.0, 0.0, rng.gauss(0, 1), 1.5]), 0.25, rng.choice([float("nan"), float("inf"), -2.0, 0.0, 3.0])
        out.append((day, day, f"S{k}", rng.choice("xy"), intent, intent, rng.random() < 0.8, rng.random() < 0.2, *scores))
    return out


def mean(x):
    x = [v for v in x if v is not None]
    return sum(x) / len(x) if x else None


def test_ranks_with_many_zeros_are_average_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 300):
        for x in (np.where(rng.random(n) < 0.6, 0.0, rng.integers(-3, 4, n)), np.zeros(n), rng.random(n) + 1, -rng.random(n)):
            wanted = 2 * np.array(average_ranks(x)) - (n + 1)
            assert (evaluate.ranks(x) == wanted).all() and (evaluate.gated_ranks(x) == wanted).all()


def test_top_days_are_those_worked_out_by_hand(spark):
    data = rows()
    got = {(r.factor, r.era, r.day): r for r in evaluate.top_days(spark.createDataFrame(data, ROW).repartition("day"), top=4, min_stocks=3).collect()}
    groups = defaultdict(list)
    for r in data:
        for name, score in zip("abc", r[8:]):
            if score is not None and np.isfinite(score):
                groups[name, r[3], r[0]].append((score, *r))
    seen = 0
    for key, part in groups.items():
        chosen = sorted((r for r in part if r[0] > 0), key=lambda r: (-r[0], r[3]))[:4]
        if len(part) < 3 or not chosen:
            assert key not in got
            continue
        seen += 1
        r, goal = got[key], [np.inf if p[5] is None else round(p[5], 9) for p in part]
        a, b = np.array(average_ranks([p[0] for p in part])), np.array(average_ranks(goal))
        ic = np.corrcoef(a, b)[0, 1] if a.std() and b.std() else None
        mine = [p[5] for p in chosen if p[5] is not None]
        assert (r.stocks, r.signals) == (len(part), len(chosen))
        assert (r.entry_no_fills, r.unclosed) == (sum(not p[7] for p in chosen), sum(p[8] for p in chosen))
        assert r.rank_ic == (ic if ic is None else pytest.approx(ic)) and r.baseline_mean == pytest.approx(mean([p[5] for p in part]))
        assert r.signal_mean == (pytest.approx(mean(mine)) if mine else None) and r.signal_median == (pytest.approx(np.median(mine)) if mine else None)
        assert r.signal_up_rate == (pytest.approx(np.mean([v > 0 for v in mine])) if mine else None)
    assert seen == len(got) > 6


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_study_deals_its_rows_once_and_sorts_no_long_ones(spark):
    """Before, each variant of an era had its own copy of the rows, and each factor a row and two sorts."""
    frame = spark.createDataFrame(rows(), ROW).drop("era", "f_a", "f_b", "f_c").repartition("day")
    wanted = {"a": "intent_return", "b": "-intent_return"}
    spans = [(f"{n}/{v}", "2024-01-01", "2024-01-03", v == "clipped") for n in ("x", "y") for v in ("free", "clipped")]
    text = plan(evaluate.top_days(evaluate.in_spans(evaluate.scored(frame, wanted, [*studies.KEYS, *studies.LABELS]), spans)))
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text


def test_labels_come_before_a_day_is_put_together(spark):
    """Before, the wide rows went to their day for the context, back to their symbol for the labels, and to their day again."""
    frame = studies.keep_all_frame(spark, "/root/testdata/sf0.001", step=1)
    text = plan(evaluate.top_days(studies.in_eras(frame, {"a": "market_return"}, studies.ERAS, studies.LABELS)))
    # The rows go to their symbol and to their day, the days of the calendar are made distinct three times.
    assert text.count("Exchange hashpartitioning(vt_symbol") == 1 and text.count("Exchange hashpartitioning(day") == 4 and "Exchange hashpartitioning(era" not in text


def test_labels_along_a_panel_are_those_of_the_joins(spark):
    rng, first, data = random.Random(11), date(2024, 1, 1), []
    for name in "ABCD":
        for k in range(30):
            if rng.random() < 0.6:  # gaps in which the next rows are too late for an entry or an exit
                data.append((name, first + timedelta(days=2 * k), *[rng.choice([0.0, 1.0 + rng.random(), None])] * 4, float(rng.randrange(3)), rng.randrange(2)))
    bars = spark.createDataFrame(data, "vt_symbol string, day date, open double, high double, low double, close double, volume double, tradestatus int")
    days = B.market_days(bars)
    columns = ["vt_symbol", "day", "entry_day", "exit_day", "entry_open", "exit_open", "mark_close", "entry_fill", "exit_fill", "intent_return", "worst_case_return", "unclosed_at_horizon"]
    wanted = labels.keep_all(bars.join(days, "day").where("exit_day IS NOT NULL"), bars).select(*columns)
    got = labels.valued(labels.along(bars, days)).where("exit_day IS NOT NULL").select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and wanted.count() > 30


def test_a_labelled_panel_is_dealt_once(spark):
    """Before, the wide rows were dealt by (symbol, entry day), by (symbol, exit day) and by symbol for their labels."""
    text = plan(labels.valued(studies.labelled_panel(B.bar_table(spark, "/root/testdata/sf0.001"))))
    assert text.count("Exchange hashpartitioning(vt_symbol") == 1


def test_a_single_series_sorts_long_rows_once(spark):
    """Before, the targets were sorted and ranked anew in the rows of each factor, which all have the same ones."""
    text = plan(studies.single_series(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Sort \[vt_symbol#\d+ [^\]]*factor#\d+ ASC NULLS FIRST, score#", text)) == 1
    assert not re.findall(r"Sort \[vt_symbol#\d+ [^\]]*factor#\d+ ASC NULLS FIRST, target#", text)


def test_scores_are_rounded_in_the_kernels_and_made_beside_the_spans(spark):
    """Before, each score went by its decimal text in Spark, and all of them were written into one method, too long for the JVM to optimise."""
    frame = spark.createDataFrame(rows(), ROW).drop("era", "f_a", "f_b", "f_c")
    scored = evaluate.scored(frame, {"a": "intent_return"}, [*studies.KEYS, *studies.LABELS])
    text = plan(evaluate.top_days(evaluate.by_era(scored, [("x", "2024-01-01", "2024-01-03")])))
    assert any("Project" in line and "f_a" in line and "filter(array(" in line for line in text.splitlines())
    assert "round(" not in "".join(line for line in text.splitlines() if "f_a" in line)


def test_kernels_round_as_sql_does():
    got = evaluate.half_up(np.array([0.5e-9, -0.5e-9, 1.4e-9, 1e300, 2.0**60, np.inf, np.nan]))
    assert got[:6].tolist() == [1e-9, -1e-9, 1e-9, 1e300, 2.0**60, np.inf] and np.isnan(got[6])
