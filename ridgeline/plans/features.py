"""The features of all studies, by stages: each stage's columns are made from those of the stages before it.

A feature is ("roll", aggregate, column, n, ending), ("lag", column, n), ("ahead", column, n) or an SQL
expression. `panel` turns the stages into window columns: one shuffle and one sort by symbol serve them all.

Spark adds a sliding frame up anew at every row, so a long frame costs its length. Where a column has long frames, `panel` makes them of
shorter ones that lie a whole number of lags back: each is NULL unless it has all its values, and so is what is made of them. Largest and
smallest values, which are exact in any order, are made so from ten rows on, and so are those that end rows before.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import ahead_max, lag, rolling

AGGREGATES = {"avg": F.avg, "stddev": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min}
#: A daily move above this makes a symbol's features and labels around it suspect.
JUMP = 0.25


def roll(how: str, column: str, n: int, ending: int = 0) -> tuple:
    return ("roll", how, column, n, ending)


def gap(a: str, b: str) -> str:
    return f"{a} / nullif({b}, 0) - 1"


VALID_BAR = "high > 0 AND low > 0 AND tradestatus = 1"

STAGES: list[dict] = [
    {f"ma{n}": roll("avg", "close", n) for n in (5, 10, 20, 40, 60, 120)}
    | {"previous_close": ("lag", "close", 1)}
    | {f"close_lag{n}": ("lag", "close", n) for n in (5, 10, 20)}
    | {"volume_mean20": roll("avg", "volume", 20), "volume_sum10": roll("sum", "volume", 10)}
    | {"high20": roll("max", "high", 20), "low20": roll("min", "low", 20)}
    | {f"prev_high{n}": roll("max", "high", n, 1) for n in (10, 20)}
    | {f"prev_low{n}": roll("min", "low", n, 1) for n in (10, 20)}
    | {"valid_high": f"CASE WHEN {VALID_BAR} THEN high END", "valid_low": f"CASE WHEN {VALID_BAR} THEN low END"},
    {
        "day_return": gap("close", "previous_close"), "short_gap": gap("ma5", "ma20"), "medium_gap": gap("ma10", "ma40"),
        "long_gap": gap("ma20", "ma60"), "slow_gap": gap("ma60", "ma120"), "ribbon_width": gap("ma5", "ma120"), "depth5": gap("ma5", "close"),
        "over_ma20": "CAST(close > ma20 AS INT)",
        "volume_ratio": "volume / nullif(volume_mean20, 0)",
        "true_range": "CASE WHEN previous_close > 0 AND valid_high IS NOT NULL THEN greatest(high - low, abs(high - previous_close), abs(low - previous_close)) END",
        "valid_high20": roll("max", "valid_high", 20), "valid_low20": roll("min", "valid_low", 20), "prev_valid_high20": roll("max", "valid_high", 20, 1),
    }
    | {f"ma5_lag{n}": ("lag", "ma5", n) for n in (1, 3, 5)}
    | {f"ma20_lag{n}": ("lag", "ma20", n) for n in (1, 3, 5, 10)}
    | {"ma10_lag5": ("lag", "ma10", 5), "ma40_lag10": ("lag", "ma40", 10), "ma60_lag10": ("lag", "ma60", 10)},
    {
        "large_jump": f"CASE WHEN abs(day_return) > {JUMP} THEN 1 ELSE 0 END", "weighted_return": "day_return * volume",
        "slope5_3": gap("ma5", "ma5_lag3"), "slope5_5": gap("ma5", "ma5_lag5"), "slope20_3": gap("ma20", "ma20_lag3"), "slope20_5": gap("ma20", "ma20_lag5"),
        "slope20_10": gap("ma20", "ma20_lag10"), "slope10_5": gap("ma10", "ma10_lag5"), "slope40_10": gap("ma40", "ma40_lag10"), "slope60_10": gap("ma60", "ma60_lag10"),
        "short_gap_lag6": ("lag", "short_gap", 6), "slow_gap_lag5": ("lag", "slow_gap", 5), "long_gap_lag5": ("lag", "long_gap", 5),
        "width_lag5": ("lag", "ribbon_width", 5), "width_lag10": ("lag", "ribbon_width", 10), "over_share20": roll("avg", "over_ma20", 20),
    }
    | {f"sd{n}": roll("stddev", "day_return", n) for n in (10, 20, 40)}
    | {f"short_gap_lag{n}": ("lag", "short_gap", n) for n in (1, 3, 5, 10)}
    | {f"medium_gap_lag{n}": ("lag", "medium_gap", n) for n in (1, 5, 10)}
    | {f"atr{n}": roll("avg", "true_range", n) for n in (5, 14, 20)},
    {
        "crossed_short": "CAST(short_gap > 0 AND short_gap_lag1 <= 0 AS INT)", "crossed_medium": "CAST(medium_gap > 0 AND medium_gap_lag1 <= 0 AS INT)",
        "above_short": "CAST(short_gap > 0 AS INT)", "above_medium": "CAST(medium_gap > 0 AS INT)",
        "delta3": "short_gap - short_gap_lag3", "delta5": "short_gap - short_gap_lag5", "delta10": "short_gap - short_gap_lag10",
        "medium_delta5": "medium_gap - medium_gap_lag5", "medium_delta10": "medium_gap - medium_gap_lag10",
        "jump60": roll("max", "large_jump", 60), "future_jump": ("ahead", "large_jump", 6), "weighted_sum10": roll("sum", "weighted_return", 10),
    },
    {f"crossed_{k}_{n}": roll("max", f"crossed_{k}", n) for k in ("short", "medium") for n in (5, 10)}
    | {f"above_{k}_{n}": roll("sum", f"above_{k}", n) for k in ("short", "medium") for n in (5, 10)}
    | {"delta5_lag5": ("lag", "delta5", 5), "recent_jump": "coalesce(jump60, 0)"},
]


#: Sums of so many rows are made of sums of RUNG rows, those of sums of STEP rows, if a column has frames of LONG rows or more.
STEP, RUNG, LONG = 5, 20, 40
#: Deviations of whole multiples of so many rows are put together from those of so many, by their means.
SPREAD = 10
EXTREME = {"max": F.greatest, "min": F.least}


def _rungs(stage: dict) -> tuple[set[str], set[str]]:
    """The columns of which a stage has long sums, and long deviations."""
    rolls = [spec[1:4] for spec in stage.values() if not isinstance(spec, str) and spec[0] == "roll" and spec[4] == 0 and spec[3] >= LONG]
    return {c for how, c, n in rolls if how in ("avg", "sum")}, {c for how, c, n in rolls if how == "stddev"}


def _extremes(stage: dict) -> dict[tuple[str, str], bool]:
    """The (aggregate, column) of the stage's largest and smallest values of whole multiples of STEP rows, and whether any has LONG rows."""
    rolls = [spec[1:4] for spec in stage.values() if not isinstance(spec, str) and spec[0] == "roll" and spec[1] in EXTREME and spec[3] % STEP == 0]
    return {(how, c): any(n >= LONG for h, x, n in rolls if (h, x) == (how, c)) for how, c, n in rolls if any(m > STEP for h, x, m in rolls if (h, x) == (how, c))}


def _extreme(how: str, column: str, n: int, ending: int, step: int = 0) -> Column:
    """The largest or smallest of n rows from those of shorter frames, whose order does not matter; NULL unless each has all its values."""
    step = step or (RUNG if n >= LONG and n % RUNG == 0 else STEP)
    name = f"__{how}_{column}_{step}"
    parts = [lag(name, k) if k else F.col(name) for k in range(ending, ending + n, step)]
    return F.when(reduce(and_, [x.isNotNull() for x in parts]), EXTREME[how](*parts)) if len(parts) > 1 else parts[0]


def _total(column: str, n: int) -> Column:
    return reduce(add, [lag(f"__{column}_{RUNG}", k) if k else F.col(f"__{column}_{RUNG}") for k in range(0, n, RUNG)])


def _deviation(column: str, n: int) -> Column:
    """The deviation of n rows from those of blocks: squares within the blocks, and of the blocks' means about theirs."""
    back = lambda name: [lag(f"__{column}_{name}", k) if k else F.col(f"__{column}_{name}") for k in range(0, n, SPREAD)]
    means = back("mean")
    middle = reduce(add, means) / len(means)
    within, about = reduce(add, [x * x for x in back("deviation")]), reduce(add, [(m - middle) * (m - middle) for m in means])
    return F.sqrt((within * (SPREAD - 1) + about * SPREAD) / (n - 1))


def panel(bars: DataFrame, stages: list[dict] | None = None) -> DataFrame:
    """bars with the columns of all stages; bars need vt_symbol, day, open, high, low, close, volume, tradestatus."""

    def made(spec, sums: set[str], deviations: set[str], extremes: dict):
        if isinstance(spec, str):
            return F.expr(spec)
        kind, *rest = spec
        if kind == "roll":
            how, column, n, ending = rest
            if column in sums and how in ("avg", "sum") and not ending and n % RUNG == 0:
                return _total(column, n) / n if how == "avg" else _total(column, n)
            if column in deviations and how == "stddev" and not ending and n % SPREAD == 0:
                return _deviation(column, n) if n > SPREAD else F.col(f"__{column}_deviation")
            if (how, column) in extremes and n % STEP == 0:
                return _extreme(how, column, n, ending)
            return rolling(AGGREGATES[how], column, n, ending)
        return lag(*rest) if kind == "lag" else ahead_max(*rest)

    for stage in STAGES if stages is None else stages:
        (sums, deviations), extremes = _rungs(stage), _extremes(stage)
        held = {f"__{c}_{STEP}": rolling(F.sum, c, STEP) for c in sums}
        held |= {f"__{c}_{name}": rolling(how, c, SPREAD) for c in deviations for name, how in (("mean", F.avg), ("deviation", F.stddev_samp))}
        held |= {f"__{how}_{c}_{STEP}": rolling(AGGREGATES[how], c, STEP) for how, c in extremes}
        bars = bars.withColumns(held) if held else bars
        rungs = {f"__{c}_{RUNG}": reduce(add, [F.col(f"__{c}_{STEP}"), *[lag(f"__{c}_{STEP}", k) for k in range(STEP, RUNG, STEP)]]) for c in sums}
        rungs |= {f"__{how}_{c}_{RUNG}": _extreme(how, c, RUNG, 0, STEP) for (how, c), long in extremes.items() if long}
        bars = bars.withColumns(rungs) if rungs else bars
        bars = bars.withColumns({name: made(spec, sums, deviations, extremes) for name, spec in stage.items()}).drop(*held, *rungs)
    return bars
