"""The studies: who is eligible on which day, with which context, and how signals are labelled.

The order of context and eligibility differs by study and matters: the keep-all study takes a day's breadth,
return and volatility over all members, the unified one over eligible members only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import average_rank, correlation, finite, melted
from ridgeline.operators import bars as B
from ridgeline.operators import labels
from ridgeline.plans import bootstrap, evaluate, factors, features

START, END = "1995-01-02", "2001-11-05"
ERAS = [("train", "1995-01-02", "1998-06-30"), ("valid", "1998-07-01", "2000-03-31"), ("test", "2000-04-01", "2001-11-05")]
TRANSFER_PERIODS = [("first", "1995-01-02", "1998-06-30"), ("second", "1998-07-01", "2000-03-31"), ("third", "2000-04-01", "2001-11-05"), ("combined", START, END)]
#: The sampling audit: the period that it looks at, and the day of the fixed pool.
SAMPLED_FROM, POOL_DAY = "1997-02-10", "1997-01-06"
#: The symbols of the transfer: they were never members.
COHORT = "l_suppkey % 3 = 0"
LABELS = ["intent_return", "worst_case_return", "entry_fill", "unclosed_at_horizon"]
KEYS = ["day", "exit_day", "vt_symbol"]
#: Weekly prices of unrelated sales move by far more than 25 %, so the censored studies run without the jump filter here;
#: jump_free_labels has it on.
ELIGIBLE = "close > 0 AND volume > 0 AND tradestatus = 1 AND is_st = 0"


def with_context(members: DataFrame, *keys: str) -> DataFrame:
    """Cross-section figures of the day (of each of the keys): shares above averages, mean return, median volatility."""
    day = Window.partitionBy(*keys, "day")
    return members.withColumns(
        {
            "breadth20": F.avg("over_ma20").over(day),
            "breadth_gap": F.avg("above_short").over(day),
            "market_return": F.round(F.avg("day_return").over(day), 12),
            "vol_median": F.median("sd20").over(day),
        }
    )


def labelled_panel(bars: DataFrame, step: int | None = 6, offset: int = 0, symbols: str = "true") -> DataFrame:
    """The features of every bar and what a signal of it meets, in one order by symbol; with a step, those of scheduled days alone.

    symbols is a condition that all bars of a symbol meet, or none; the market days are those of all symbols.
    """
    days = B.market_days(bars)
    panel = features.panel(labels.along(bars.where(symbols), days))
    if step is None:
        return panel
    # One row per scheduled market day: a side that does not grow with the number of symbols.
    return panel.join(F.broadcast(B.schedule(days, START, END, step, offset).select("day")), "day", "left_semi")


def keep_all_frame(spark: SparkSession, sf_dir: str, step: int = 6, offset: int = 0) -> DataFrame:
    """The keep-all study: members with context, eligible by what is known on the day, every signal labelled."""
    bars = B.bar_table(spark, sf_dir)
    # A day's context needs that day alone, so days that are not scheduled fall out first. Labels are made where the symbol's rows are,
    # those of members that are not eligible too, and so the wide rows are dealt once: by day.
    members = B.members_only(labelled_panel(bars, step, offset), B.membership(spark, sf_dir))
    rows = with_context(labels.valued(members))
    return rows.where(ELIGIBLE).where(finite("long_gap") & finite("depth5"))


def unified_frame(spark: SparkSession, sf_dir: str, step: int = 6, offset: int = 0) -> DataFrame:
    """The unified study: members of scheduled days that have a bar, context after eligibility.

    A snapshot's members without a bar have no price and are never eligible, so the bars are asked for their members.
    """
    bars = B.bar_table(spark, sf_dir)
    rows = B.members_only(labelled_panel(bars, step, offset), B.membership(spark, sf_dir))
    rows = rows.where(ELIGIBLE).where(finite("ma120") & finite("long_gap") & finite("depth5"))
    return with_context(labels.valued(rows))


def censored_frame(spark: SparkSession, sf_dir: str, use_status: bool = False, use_jumps: bool = False) -> DataFrame:
    """The first study and its follow-up: members with context, labels filtered by what happened later."""
    bars = B.bar_table(spark, sf_dir)
    members = B.members_only(labelled_panel(bars), B.membership(spark, sf_dir))
    return labels.uncensored(with_context(members), use_jumps=use_jumps, use_status=use_status)


def scores(frame: DataFrame, study: str, digits: int = 6) -> DataFrame:
    """The wide score table of a study: day, vt_symbol, one column per factor."""
    wanted = factors.STUDIES[study]
    return frame.select("day", "vt_symbol", *[F.round(F.expr(x).cast("double"), digits).alias(name) for name, x in wanted.items()])


def in_eras(frame: DataFrame, wanted: dict[str, str], eras: list, labelled: list[str], clip_exit: bool = True) -> DataFrame:
    """The scored rows of all eras, which are named where the rows are."""
    return evaluate.by_era(evaluate.scored(frame, wanted, [*KEYS, *labelled]), eras, clip_exit)


def top_daily(frame: DataFrame, study: str, eras=ERAS, min_stocks: int = 50, clip_exit: bool = True) -> DataFrame:
    return evaluate.top_days(in_eras(frame, factors.STUDIES[study], eras, LABELS, clip_exit), min_stocks=min_stocks)


def signal_daily(frame: DataFrame, study: str, eras=ERAS, min_stocks: int = 50, min_signals: int = 20) -> DataFrame:
    return evaluate.positive_signal_days(in_eras(frame, factors.STUDIES[study], eras, ["forward_return"]), min_stocks=min_stocks, min_signals=min_signals)


def single_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-series study for each symbol: 12 features, return from next open to the open six rows on,
    every sixth complete row, split 60/20/20 in time, rank correlation by part, the best of what held up.

    Rows (vt_symbol, factor, train_rows, valid_rows, test_rows, train_ic, valid_ic, test_ic, is_selected).
    """
    rows = Window.partitionBy("vt_symbol").orderBy("day")
    panel = features.panel(B.bar_table(spark, sf_dir))
    # Here a comparison with a missing average counts as false, not as missing.
    above = F.when(F.col("short_gap") > 0, 1.0).otherwise(0.0)
    panel = panel.withColumn("above", above).withColumn("above_share10", features.rolling(F.avg, "above", 10))
    target = F.try_divide(F.lead("open", 6).over(rows), F.lead("open", 1).over(rows)) - 1
    wanted = factors.SINGLE
    full = panel.select("vt_symbol", "day", F.round(target, evaluate.DIGITS).alias("target"), *[F.round(F.expr(x).cast("double"), evaluate.DIGITS).alias(n) for n, x in wanted.items()])
    full = full.dropna(how="any")
    full = full.withColumn("number", F.row_number().over(rows) - 1).where("number % 6 = 0").withColumn("number", F.col("number") / 6)
    size = F.count("*").over(Window.partitionBy("vt_symbol"))
    part = F.when(F.col("number") < F.floor(size * F.lit(0.6)), "train").when(F.col("number") < F.floor(size * F.lit(0.8)), "valid").otherwise("test")
    # Rows are complete, so every factor meets the same targets: they are ranked once, before there is a row for each factor.
    full = full.withColumn("part", part).withColumn("b", average_rank("target", "vt_symbol", "part"))
    long = melted(full, ["vt_symbol", "part", "b"], {n: F.col(n) for n in wanted}, "factor", "score")
    long = long.withColumn("a", average_rank("score", "vt_symbol", "part", "factor"))
    ic = long.groupBy("vt_symbol", "factor", "part").agg(F.count("*").alias("n"), F.round(correlation("a", "b"), evaluate.DIGITS).alias("ic"))
    parts = ("train", "valid", "test")
    out = ic.groupBy("vt_symbol", "factor").agg(
        *[F.coalesce(F.max(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"{p}_rows") for p in parts],
        *[F.max(F.when(F.col("part") == p, F.col("ic"))).alias(f"{p}_ic") for p in parts],
    )
    held = F.coalesce((F.col("train_ic") > 0) & (F.col("valid_ic") > 0), F.lit(False))
    best = F.row_number().over(Window.partitionBy("vt_symbol").orderBy(held.desc(), F.col("valid_ic").desc_nulls_last(), "factor"))
    return out.withColumn("is_selected", held & (best == 1))


def boundary_rows(frame: DataFrame, study: str, eras=ERAS) -> DataFrame:
    """The scored rows of each era with and without signals whose exit lies past it: an era per variant, NAME/free and NAME/clipped.

    Both variants are spans of one evaluation, so the scores are made once.
    """
    spans = [(f"{n}/{variant}", a, b, variant == "clipped") for n, a, b in eras for variant in ("free", "clipped")]
    return evaluate.in_spans(evaluate.scored(frame, factors.STUDIES[study], [*KEYS, *LABELS]), spans)


def by_variant(figures: DataFrame) -> DataFrame:
    named = F.split("era", "/")
    return figures.withColumns({"era": named[0], "variant": named[1]})


def boundary_summary(frame: DataFrame, study: str, eras=ERAS, min_stocks: int = 50) -> DataFrame:
    """The summary of each factor and era by `variant`."""
    return by_variant(evaluate.top_summary(evaluate.top_days(boundary_rows(frame, study, eras), min_stocks=min_stocks)))


def boundary(frame: DataFrame, study: str) -> DataFrame:
    """How clipping signals whose exit lies past their era changes each factor: its rows crossing, edges with and without.

    A factor's rows are those with a finite score, on scheduled days, whose exit is known; so the crossing ones are those that the clipped variant lacks.
    """
    figures = evaluate.held_figures(boundary_rows(frame, study))
    of = lambda variant: F.coalesce(F.sum(F.when(F.col("variant") == variant, F.col("stocks"))), F.lit(0))
    counts = by_variant(figures.where("factor IS NOT NULL")).groupBy("factor", "era").agg((of("free") - of("clipped")).alias("crossing_rows"))
    pick = lambda c, variant: F.max(F.when(F.col("variant") == variant, F.col(c))).alias(f"{c}_{variant}")
    summary = by_variant(evaluate.top_summary(evaluate.kept_days(figures)))
    both = summary.groupBy("factor", "era").agg(*[pick(c, v) for v in ("free", "clipped") for c in ("edge", "days")])
    out = counts.join(both, ["factor", "era"], "left")
    same = F.col("edge_free").eqNullSafe(F.col("edge_clipped")) | (F.abs(F.col("edge_free") - F.col("edge_clipped")) <= 1e-9)
    return out.withColumn("changed", ~F.coalesce(same, F.lit(False)))


def offsets(spark: SparkSession, sf_dir: str, factor: str = "uptrend_pullback", step: int = 6) -> DataFrame:
    """One factor evaluated on each of the step possible sampling calendars: one pass over the panel, calendars unioned."""
    bars = B.bar_table(spark, sf_dir)
    days = B.market_days(bars)
    calendars = [B.schedule(days, START, END, step, k).withColumn("era", F.lit(f"offset {k}")) for k in range(step)]
    calendar = calendars[0]
    for more in calendars[1:]:
        calendar = calendar.unionByName(more)
    members = B.members_only(labelled_panel(bars, None), B.membership(spark, sf_dir)).join(F.broadcast(calendar.select("day", "era")), "day")
    rows = with_context(labels.valued(members), "era").where(ELIGIBLE).where(finite("long_gap") & finite("depth5"))
    scored = evaluate.scored(rows, {factor: factors.STUDIES["unified"][factor]}, [*KEYS, "era", *LABELS])
    return evaluate.top_summary(evaluate.top_days(scored))


def dense_days(spark: SparkSession, sf_dir: str, factor: str = "market_down_day") -> DataFrame:
    """One factor on every market day, by year: each day of the year's grid counts, days without signals as missing."""
    frame = keep_all_frame(spark, sf_dir, step=1)
    years = [(str(y), f"{y}-01-01", f"{y}-12-31") for y in range(1995, 2002)]
    figures = evaluate.held_figures(in_eras(frame, {factor: factors.STUDIES["clean"][factor]}, years, LABELS))
    grid = evaluate.cross_sections(figures).select("era", "day")
    daily = evaluate.kept_days(figures, min_stocks=1).select("era", "day", "signals", "signal_mean", "edge", "signal_up_rate", "entry_no_fills", "unclosed")
    return grid.join(daily, ["era", "day"], "left")


def dense_summary(daily: DataFrame) -> DataFrame:
    out = daily.groupBy("era").agg(
        F.count("*").alias("market_dates"), F.count("signals").alias("signal_days"), F.coalesce(F.sum("signals"), F.lit(0)).alias("selected_stocks"),
        F.avg("signal_mean").alias("signal_mean"), F.avg("edge").alias("edge"), F.median("signal_mean").alias("median_signal_day_mean"), F.avg("signal_up_rate").alias("signal_up_rate_mean"),
        F.coalesce(F.sum("entry_no_fills"), F.lit(0)).alias("selected_no_entry"), F.coalesce(F.sum("unclosed"), F.lit(0)).alias("selected_unclosed"),
    )
    return out.withColumn("after_cost", F.col("signal_mean") - evaluate.COST)


def transfer(spark: SparkSession, sf_dir: str, factor: str = "ribbon_joint_widening", min_stocks: int = 5) -> DataFrame:
    """A locked rule on another universe: symbols that were never members, daily features, then scheduled days only."""
    bars = B.bar_table(spark, sf_dir)
    # Every scheduled day is a day of the daily calendar too.
    rows = labelled_panel(bars, symbols=COHORT).where(ELIGIBLE).where(finite("ma120") & finite("long_gap") & finite("depth5"))
    rows = labels.valued(rows)
    scored = in_eras(rows, {factor: factors.STUDIES["price"][factor]}, [*ERAS, ("combined", START, END)], LABELS)
    return evaluate.top_summary(evaluate.top_days(scored, min_stocks=min_stocks))


# Audits of a locked rule


def transfer_rows(spark: SparkSession, sf_dir: str, factor: str, step: int, periods: list) -> tuple[DataFrame, DataFrame]:
    """The scored rows of a rule on symbols that were never members, and its grid: each scheduled day of each period whose exit is in it."""
    bars = B.bar_table(spark, sf_dir)
    calendar = B.schedule(B.market_days(bars), START, END, step)
    rows = labelled_panel(bars, step, symbols=COHORT).where(ELIGIBLE).where(finite("ma120") & finite("long_gap") & finite("depth5"))
    scored = in_eras(labels.valued(rows), {factor: factors.STUDIES["price"][factor]}, periods, LABELS)
    return scored, evaluate.by_era(calendar, periods).select("era", "day")


def net_intervals(daily: DataFrame, grid: DataFrame, block: int, seed: int, keys: tuple[str, ...] = ("era",)) -> DataFrame:
    """Per key: the interval of the signals' mean less cost, and that of the edge, over every day of the grid (keys, day).

    Days without a signal are drawn like others and left out of a replicate's mean.
    """
    series = grid.join(daily.select(*keys, "day", "signal_mean", "edge"), [*keys, "day"], "left")
    own = bootstrap.intervals(series, block, seed, keys=keys, value="signal_mean")
    own = own.select(*keys, (F.col("low") - evaluate.COST).alias("net_low"), (F.col("high") - evaluate.COST).alias("net_high"))
    edge = bootstrap.intervals(series, block, seed + 1000, keys=keys, value="edge").select(*keys, F.col("low").alias("block_edge_low"), F.col("high").alias("block_edge_high"))
    dates = series.groupBy(*keys).agg(F.count("*").alias("grid_dates"), F.count("signal_mean").alias("signal_dates"))
    return dates.join(own, list(keys), "left").join(edge, list(keys), "left")


def transfer_audit(spark: SparkSession, sf_dir: str, factor: str = "ribbon_joint_widening", step: int = 1, min_stocks: int = 5, seed: int = 24) -> DataFrame:
    """The locked rule's summary by period with net_low, the lower end of its net mean over blocks of four scheduled days."""
    scored, grid = transfer_rows(spark, sf_dir, factor, step, TRANSFER_PERIODS)
    daily = evaluate.top_days(scored, min_stocks=min_stocks)
    return evaluate.top_summary(daily).join(net_intervals(daily, grid, 4, seed), "era")


def round_intervals(frame: DataFrame, study: str, eras=ERAS, min_stocks: int = 20, seed: int = 24) -> DataFrame:
    """The net interval of every factor of a study in every era, over the days on which the study has rows."""
    figures = evaluate.held_figures(in_eras(frame, factors.STUDIES[study], eras, LABELS))
    grid = evaluate.cross_sections(figures).select("era", "day")
    grid = grid.withColumn("factor", F.explode(F.array(*[F.lit(n) for n in factors.STUDIES[study]])))
    return net_intervals(evaluate.kept_days(figures, min_stocks), grid, 4, seed, ("factor", "era"))


def sampling_cases(spark: SparkSession, sf_dir: str, factor: str = "old_market_down_pullback", min_stocks: int = 20) -> DataFrame:
    """One rule on two sampling anchors and two pools: the whole history's calendar or one that starts anew with the period,
    the members of the day or those of one fixed day.

    Calendars and pools are rows (anchor, pool, day, vt_symbol), so the panel is read and labelled once for all four cases. Every
    scheduled day meets the whole fixed pool: days are a calendar's, and the pool is one snapshot's.
    """
    bars = B.bar_table(spark, sf_dir)
    days, members = B.market_days(bars), B.membership(spark, sf_dir)
    since = B.schedule(days, START, END).where(F.col("day") >= F.lit(SAMPLED_FROM).cast("date")).withColumn("anchor", F.lit("history"))
    calendar = since.unionByName(B.schedule(days, SAMPLED_FROM, END).withColumn("anchor", F.lit("period"))).select("anchor", "day", "entry_day", "exit_day")
    dates = F.broadcast(calendar)  # two rows per market day at most
    moving = members.join(dates, F.col("day").between(F.col("member_start"), F.col("member_end")))
    fixed = members.where(F.lit(POOL_DAY).cast("date").between(F.col("member_start"), F.col("member_end"))).crossJoin(dates)
    columns = ["anchor", "pool", "day", "entry_day", "exit_day", "vt_symbol"]
    cases = moving.withColumn("pool", F.lit("moving")).select(*columns).unionByName(fixed.withColumn("pool", F.lit("fixed")).select(*columns))
    rows = cases.join(features.panel(bars), ["vt_symbol", "day"]).where(ELIGIBLE).where(finite("ma120") & finite("long_gap") & finite("depth5"))
    rows = with_context(labels.keep_all(rows, bars), "anchor", "pool").withColumn("era", F.concat_ws("/", "anchor", "pool"))
    scored = evaluate.scored(rows, {factor: factors.STUDIES["unified"][factor]}, [*KEYS, "era", *LABELS])
    return evaluate.top_summary(evaluate.top_days(scored, min_stocks=min_stocks))
