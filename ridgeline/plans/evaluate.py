"""Evaluation kernels over rows (day, exit_day, vt_symbol, era, labels, f_NAME for each factor): all factors and eras in one job.

A cross-section is one era's day. Rows stay wide: Spark deals and groups them by day, and a column of scores at a time is ranked
where they are, so nothing is sorted, spilled or shuffled once for each factor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import rate
from ridgeline.sources import files

COST = 0.003
#: Scores and returns are rounded to so many digits before they are ranked: sums differ in their last bits. The kernels do it, a column
#: at a time: Spark's own round of a double goes by way of its decimal text, for each row and factor.
DIGITS = 9
PREFIX = "f_"


def scored(frame: DataFrame, factors: dict[str, str], keep: list[str]) -> DataFrame:
    """keep and a score f_NAME for each factor, which the kernels round.

    Rows that were put together by day for their context stay so, and eras named in place keep them there: the kernels deal none anew.
    """
    return frame.select(*keep, *[F.expr(x).cast("double").alias(f"{PREFIX}{name}") for name, x in factors.items()])


def by_era(rows: DataFrame, eras: list[tuple[str, str, str]], clip_exit: bool = True) -> DataFrame:
    """rows with their era; a row whose exit is after its era's end belongs to none, unless clip_exit is off."""
    return in_spans(rows, [(*e, clip_exit) for e in eras])


def in_spans(rows: DataFrame, spans: list[tuple[str, str, str, bool]]) -> DataFrame:
    """rows once for each span (name, start, end, clip_exit) that they are in, with its name as era: a handful, which may overlap.

    The spans are listed beside the scores before they are exploded. Spark compiles a projection that has such a list by itself, in short
    methods; without it, a study's scores are written into the method of the whole stage, which is then too long for the JVM to optimise.
    """

    def named(name: str, start: str, end: str, clip: bool) -> Column:
        inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        return F.when(inside & (F.col("exit_day") <= F.lit(end).cast("date")) if clip else inside, F.lit(name))

    listed = rows.withColumn("era", F.array_compact(F.array(*[named(*s) for s in spans])))
    return listed.withColumn("era", F.explode("era"))


def _number(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NULL as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy()


def half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """x rounded as SQL rounds a double: x times a power of ten, halves away from 0, and back; x itself where that is no finite number."""
    power = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        large = x * power
        whole = np.trunc(large)
        out = (whole + np.where(np.abs(large - whole) >= 0.5, np.copysign(1.0, large), 0.0)) / power
    return np.where(np.isfinite(out), out, x)


def ranks(x: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Average ranks of x, moved so that they add up to 0, times two: whole numbers, exact as doubles. order, if given, sorts x."""
    n = len(x)
    order = np.argsort(x) if order is None else order
    held = x[order]
    first = np.concatenate([[True], held[1:] != held[:-1]])[:n]
    start = np.flatnonzero(first)
    out = np.empty(n)
    out[order] = (start + np.append(start[1:], n) - n)[np.cumsum(first) - 1]
    return out


def gated_ranks(x: np.ndarray) -> np.ndarray:
    """ranks(x) where most of x may be 0: only the rest is sorted."""
    n, other = len(x), np.flatnonzero(x)
    zeros = n - len(other)
    if not zeros:
        return ranks(x)
    values = x[other]
    below = int(np.count_nonzero(values < 0))
    out = np.full(n, float(2 * below + zeros - n))
    # ranks() has places among the rest: those above 0 come after the zeros, and the middle is that of all.
    out[other] = ranks(values) + np.where(values > 0, zeros, -zeros)
    return out


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    of = float(a @ a), float(b @ b)
    return float(a @ b) / (of[0] ** 0.5 * of[1] ** 0.5) if of[0] and of[1] else None


def _mean(x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    return float(x.mean()) if len(x) else None


def _up(x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    return float((x > 0).mean()) if len(x) else None


def each_cross_section(rows: DataFrame, target: str, figures: str, made: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """One row (factor, era, day, stocks, rank_ic, figures) for each factor of a cross-section in which it has finite scores, and one without
    a factor, whose stocks are all rows of the cross-section.

    made(table, chosen, score, target) has the other figures, chosen being the places of the rows with a finite score. Scores and targets
    are rounded first.
    """
    keys = rows.select("era", "day").schema
    schema = f"factor string, era {keys['era'].dataType.simpleString()}, day {keys['day'].dataType.simpleString()}, stocks long, rank_ic double, {figures}"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "date": pa.date32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}
    arrow = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, schema.split(", "))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        goal = half_up(_number(table, target))
        sorted_as = np.where(np.isnan(goal), np.inf, goal)  # a missing target comes last, as in SQL
        order = np.argsort(sorted_as)
        whole, out = None, [{"era": key[0].as_py(), "day": key[1].as_py(), "stocks": len(table)}]
        for name in table.column_names:
            if not name.startswith(PREFIX):
                continue
            score = half_up(_number(table, name))
            known = np.isfinite(score)
            at = np.flatnonzero(known)
            if not len(at):
                continue
            if len(at) == len(score):
                whole = ranks(sorted_as, order) if whole is None else whole
                mine, of = score, whole
            else:  # the rows that are left keep their order
                place = np.cumsum(known) - 1
                mine, of = score[at], ranks(sorted_as[at], place[order[known[order]]])
            found = {"factor": name.removeprefix(PREFIX), "era": key[0].as_py(), "day": key[1].as_py(), "stocks": len(at), "rank_ic": _correlation(gated_ranks(mine), of)}
            out.append(found | made(table, at, mine, goal[at]))
        return pa.Table.from_pylist(out, arrow)

    return rows.groupBy("era", "day").applyInArrow(run, schema)


def positive_signal_days(rows: DataFrame, target: str = "forward_return", min_stocks: int = 50, min_signals: int = 20) -> DataFrame:
    """One row (factor, era, day): statistics of the cross-section, a signal being a positive score."""

    def made(table: pa.Table, at: np.ndarray, score: np.ndarray, target: np.ndarray) -> dict:
        signal = target[score > 0]
        return {"signals": len(signal), "baseline_mean": _mean(target), "signal_mean": _mean(signal), "signal_up_rate": _up(signal), "baseline_up_rate": _up(target)}

    daily = each_cross_section(rows.drop("exit_day", "vt_symbol"), target, "signals long, baseline_mean double, signal_mean double, signal_up_rate double, baseline_up_rate double", made)
    kept = daily.where((F.col("stocks") >= min_stocks) & (F.col("signals") >= min_signals) & F.col("rank_ic").isNotNull())
    return kept.withColumn("edge", F.round(F.col("signal_mean") - F.col("baseline_mean"), DIGITS))


def positive_signal_summary(daily: DataFrame, *groups: str) -> DataFrame:
    """Equal weight to every day: one row per factor and era."""
    out = daily.groupBy(*(groups or ("factor", "era"))).agg(
        F.count("*").alias("days"), F.sum("signals").alias("signals"),
        *[F.avg(c).alias(n) for c, n in (("stocks", "stocks_per_day"), ("signal_mean", "signal_mean"), ("baseline_mean", "baseline_mean"), ("signal_up_rate", "signal_up_rate"), ("baseline_up_rate", "baseline_up_rate"), ("edge", "edge"))],
        F.stddev_samp("edge").alias("edge_daily_sd"), rate(F.col("edge") > 0).alias("edge_positive_day_fraction"), F.avg("rank_ic").alias("rank_ic"), F.stddev_samp("rank_ic").alias("rank_ic_daily_sd"),
    )
    return out.withColumn("signal_return_after_cost", F.col("signal_mean") - COST)


def best(score: np.ndarray, symbols: pa.ChunkedArray, at: np.ndarray, top: int) -> np.ndarray:
    """The places of the `top` largest positive scores, equal ones in order of symbol; at are the rows of the scores."""
    above = np.flatnonzero(score > 0)
    if len(above) <= top:
        return above
    least = np.partition(score[above], len(above) - top)[len(above) - top]
    more, even = above[score[above] > least], above[score[above] == least]
    if len(more) + len(even) > top:
        names = symbols.take(pa.array(at[even])).to_pylist()
        even = even[sorted(range(len(even)), key=names.__getitem__)[: top - len(more)]]
    return np.concatenate([more, even])


def top_figures(rows: DataFrame, top: int = 20) -> DataFrame:
    """One row (factor, era, day): statistics of the cross-section, selected being the `top` best positive scores, and one without a factor
    for each cross-section.

    Equal scores are taken in order of symbol. A day of constant scores has no rank correlation.
    """

    def made(table: pa.Table, at: np.ndarray, score: np.ndarray, intent: np.ndarray) -> dict:
        chosen = best(score, table.column("vt_symbol"), at, top)
        mine, of = intent[chosen], table.select(["worst_case_return", "entry_fill", "unclosed_at_horizon"]).take(pa.array(at[chosen]))
        known = mine[~np.isnan(mine)]
        return {
            "signals": len(chosen), "baseline_mean": _mean(intent), "signal_mean": _mean(mine), "signal_median": float(np.median(known)) if len(known) else None,
            "signal_worst_case_mean": _mean(half_up(_number(of, "worst_case_return"))), "signal_up_rate": _up(mine), "baseline_up_rate": _up(intent),
            "entry_no_fills": of.column("entry_fill").to_pylist().count(False), "unclosed": of.column("unclosed_at_horizon").to_pylist().count(True),
        }

    figures = "signals long, baseline_mean double, signal_mean double, signal_median double, signal_worst_case_mean double, signal_up_rate double, baseline_up_rate double, entry_no_fills long, unclosed long"
    return each_cross_section(rows.drop("exit_day"), "intent_return", figures, made)


def kept_days(figures: DataFrame, min_stocks: int = 50) -> DataFrame:
    """The days of factors that have stocks and a signal, with their edge."""
    kept = figures.where((F.col("stocks") >= min_stocks) & (F.col("signals") >= 1))
    return kept.withColumn("edge", F.round(F.col("signal_mean") - F.col("baseline_mean"), DIGITS))


def top_days(rows: DataFrame, top: int = 20, min_stocks: int = 50) -> DataFrame:
    return kept_days(top_figures(rows, top), min_stocks)


def held_figures(rows: DataFrame, top: int = 20) -> DataFrame:
    """top_figures as a table for what reads them more than once: a row per factor and day, whatever the number of symbols.

    The panel, its labels and scores are worked out once for all that is made of them.
    """
    files.shared_folder(rows.sparkSession)
    return top_figures(rows, top).checkpoint()


def cross_sections(figures: DataFrame) -> DataFrame:
    """era, day and the rows of each cross-section."""
    return figures.where("factor IS NULL").select("era", "day", F.col("stocks").alias("rows"))


def top_summary(daily: DataFrame, *groups: str) -> DataFrame:
    out = daily.groupBy(*(groups or ("factor", "era"))).agg(
        F.count("*").alias("days"), F.sum("signals").alias("signals"), F.avg("stocks").alias("stocks_per_day"), F.avg("signal_mean").alias("signal_mean"),
        F.median("signal_median").alias("signal_median_across_days"), F.avg("signal_worst_case_mean").alias("signal_worst_case_mean"), F.avg("baseline_mean").alias("baseline_mean"),
        F.avg("edge").alias("edge"), F.stddev_samp("edge").alias("edge_sd"), F.median("edge").alias("edge_median_across_days"), F.avg("signal_up_rate").alias("signal_up_rate"),
        F.avg("baseline_up_rate").alias("baseline_up_rate"), F.avg("rank_ic").alias("rank_ic"), F.count("rank_ic").alias("rank_ic_days"),
        F.sum("entry_no_fills").alias("entry_no_fills"), F.sum("unclosed").alias("unclosed_at_horizon"),
    )
    half = F.when(F.col("days") > 1, 1.96 * F.col("edge_sd") / F.sqrt("days"))
    return out.withColumns({"after_cost": F.col("signal_mean") - COST, "edge_low": F.col("edge") - half, "edge_high": F.col("edge") + half})
