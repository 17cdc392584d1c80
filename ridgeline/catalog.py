"""All registered queries of the engine and the SQL that they are checked against."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import oracles as O
from ridgeline.functions.columns import average_rank
from ridgeline.operators import bars as B
from ridgeline.operators import checks, labels, quality
from ridgeline.plans import bootstrap, evaluate, factors, features, screens, studies
from ridgeline.sources import arrow, code, files, provider
from ridgeline.streaming import journal, lifecycle, routing, rules, ticks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SIGNAL = "stocks_per_day, signal_mean, baseline_mean, signal_up_rate, baseline_up_rate, edge, edge_daily_sd, edge_positive_day_fraction, rank_ic, rank_ic_daily_sd, signal_return_after_cost"
TOP = "stocks_per_day, signal_mean, signal_median_across_days, signal_worst_case_mean, baseline_mean, edge, edge_sd, edge_median_across_days, signal_up_rate, baseline_up_rate, rank_ic, after_cost, edge_low, edge_high"


def query(sql: str | None = None):
    """Registers a query by its function's name, and its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(frame: DataFrame, names: str, plain: str = "") -> DataFrame:
    return frame.select(*[p.strip() for p in plain.split(",") if p.strip()], *[F.round(F.col(n.strip()).cast("double"), 6).alias(n.strip()) for n in names.split(",")])


# Bars, calendars, membership


@query(O.query([O.BARS], "SELECT vt_symbol, day, open, high, low, close, volume, turnover, vwap, tradestatus, is_st FROM bars"))
def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.weekly_bars(spark, sf_dir).select("vt_symbol", "day", "open", "high", "low", "close", "volume", "turnover", "vwap", "tradestatus", "is_st")


@query(O.query([O.BARS, O.DAYS, O.schedule()], "SELECT day, entry_day, exit_day, ordinal FROM schedule"))
def sampling_calendar(spark, sf_dir):
    return B.schedule(B.market_days(B.bar_table(spark, sf_dir)), studies.START, studies.END)


@query(O.query([O.BARS, O.MEMBERSHIP], "SELECT b.vt_symbol, b.day FROM bars b JOIN membership m ON b.vt_symbol = m.vt_symbol AND b.day BETWEEN member_start AND member_end"))
def interval_membership(spark, sf_dir):
    return B.members_only(B.bar_table(spark, sf_dir), B.membership(spark, sf_dir)).select("vt_symbol", "day")


@query(O.query([O.BARS, O.DAYS, O.MEMBERSHIP], """SELECT members, count(*) AS days, min(day) AS first_day FROM (
  SELECT day, count(*) AS members FROM days JOIN membership ON day BETWEEN member_start AND member_end GROUP BY day) GROUP BY members"""))
def member_count_distribution(spark, sf_dir):
    return quality.member_counts(B.membership(spark, sf_dir), B.market_days(B.bar_table(spark, sf_dir)))


@query(O.query([O.BARS, O.DAYS, O.MEMBERSHIP], """SELECT day, count(*) AS missing, min(vt_symbol) AS first_missing FROM days JOIN membership ON day BETWEEN member_start AND member_end
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.day = days.day AND b.vt_symbol = membership.vt_symbol) GROUP BY day"""))
def members_without_bars(spark, sf_dir):
    bars = B.bar_table(spark, sf_dir)
    return quality.members_without_bars(B.snapshot_members(B.membership(spark, sf_dir), B.market_days(bars)), bars)


@query("""SELECT CAST(isoyear(day) AS INT) AS iso_year, CAST(weekofyear(day) AS INT) AS iso_week, min(day) AS day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY ALL""")
def first_day_of_iso_weeks(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = B.first_day_of_weeks(days)
    return out.select(F.col("iso_year").cast("int"), F.col("iso_week").cast("int"), "day")


# Features and scores

FEATURES = "day_return, short_gap, long_gap, slow_gap, sd20, volume_ratio, slope5_3, slope40_10, atr14, over_share20, weighted_sum10, crossed_short_5, above_medium_10, delta5_lag5, recent_jump, future_jump"


@query(O.query([O.BARS, O.panel()], O.rounded(FEATURES, "panel", "vt_symbol, day")))
def feature_panel(spark, sf_dir):
    return rounded(features.panel(B.bar_table(spark, sf_dir)), FEATURES, "vt_symbol, day")


@query(O.query(O.censored(), O.wide("stock")))
def stock_scores(spark, sf_dir):
    return studies.scores(studies.censored_frame(spark, sf_dir), "stock")


@query(O.query(O.censored(True), O.wide("followup")))
def followup_scores(spark, sf_dir):
    return studies.scores(studies.censored_frame(spark, sf_dir, use_status=True), "followup")


@query(O.query(O.keep_all(), O.wide("clean")))
def keep_all_scores(spark, sf_dir):
    return studies.scores(studies.keep_all_frame(spark, sf_dir), "clean")


@query(O.query(O.unified(), O.wide("unified")))
def unified_scores(spark, sf_dir):
    return studies.scores(studies.unified_frame(spark, sf_dir), "unified")


@query(O.query(O.unified(), O.wide("price")))
def price_scores(spark, sf_dir):
    return studies.scores(studies.unified_frame(spark, sf_dir), "price")


# Labels

LABEL_COLUMNS = "intent_return, worst_case_return"


@query(O.query(O.keep_all(), O.rounded(LABEL_COLUMNS, "frame", "day, vt_symbol, entry_day, exit_day, entry_open, exit_open, mark_close, entry_fill, exit_fill, unclosed_at_horizon")))
def keep_all_labels(spark, sf_dir):
    return rounded(studies.keep_all_frame(spark, sf_dir), LABEL_COLUMNS, "day, vt_symbol, entry_day, exit_day, entry_open, exit_open, mark_close, entry_fill, exit_fill, unclosed_at_horizon")


@query(O.query(O.censored(), O.rounded("forward_return", "frame", "day, vt_symbol, exit_day, recent_jump, future_jump")))
def censored_labels(spark, sf_dir):
    return rounded(studies.censored_frame(spark, sf_dir), "forward_return", "day, vt_symbol, exit_day, recent_jump, future_jump")


@query(O.query(O.censored(True), "SELECT day, count(*) AS stocks, count_if(recent_jump = 0 AND future_jump = 0) AS quiet, round(avg(forward_return), 6) AS mean_return FROM frame GROUP BY day"))
def followup_labels(spark, sf_dir):
    frame = studies.censored_frame(spark, sf_dir, use_status=True)
    quiet = F.count_if((F.col("recent_jump") == 0) & (F.col("future_jump") == 0))
    return frame.groupBy("day").agg(F.count("*").alias("stocks"), quiet.alias("quiet"), F.round(F.avg("forward_return"), 6).alias("mean_return"))


@query("""SELECT e.event_id, e.user_id, coalesce(o.o_orderkey, -1) AS last_order FROM events e ASOF LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 24 YEAR AS at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1) o
ON o.o_custkey = e.user_id AND o.at <= e.ts""")
def as_of_join(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    facts = orders.select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + INTERVAL '24' YEAR").alias("at"), "last_order")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return labels.as_of(events, "ts", facts, "at", "user_id", ["last_order"]).select("event_id", "user_id", F.coalesce("last_order", F.lit(-1)).alias("last_order"))


# Evaluation


def _weekly_study(spark, sf_dir, min_stocks, min_signals):
    long = studies.in_eras(studies.censored_frame(spark, sf_dir), {"ma5_ma20": factors.STOCK["ma5_ma20"]}, studies.ERAS, ["forward_return"])
    daily = evaluate.positive_signal_days(long, min_stocks=min_stocks, min_signals=min_signals)
    return rounded(evaluate.positive_signal_summary(daily), SIGNAL, "factor, era, days, signals")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly study with minima that the smallest tables can meet."""
    return _weekly_study(spark, sf_dir, 3, 1)


@query(O.query([*O.censored(), O.long_rows({"ma5_ma20": factors.STOCK["ma5_ma20"]}, O.SIGNAL_COLUMNS), O.eras(), O.signal_days(3, 1)], O.rounded(SIGNAL, "summary", "factor, era, days, signals")))
def weekly_factor_study(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(O.query([*O.censored(), O.long_rows("stock", O.SIGNAL_COLUMNS), O.eras(), O.signal_days(20, 5)], O.rounded(SIGNAL, "summary", "factor, era, days, signals")))
def stock_summary(spark, sf_dir):
    daily = studies.signal_daily(studies.censored_frame(spark, sf_dir), "stock", min_stocks=20, min_signals=5)
    return rounded(evaluate.positive_signal_summary(daily), SIGNAL, "factor, era, days, signals")


@query(O.query([*O.censored(True), O.long_rows("followup", O.SIGNAL_COLUMNS), O.eras(), O.signal_days(20, 5)], O.rounded(SIGNAL, "summary", "factor, era, days, signals")))
def followup_summary(spark, sf_dir):
    daily = studies.signal_daily(studies.censored_frame(spark, sf_dir, use_status=True), "followup", min_stocks=20, min_signals=5)
    return rounded(evaluate.positive_signal_summary(daily), SIGNAL, "factor, era, days, signals")


@query(O.query([*O.keep_all(), O.long_rows("clean", O.TOP_COLUMNS), O.eras(), O.top_days(20)], O.rounded(TOP, "summary", "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")))
def keep_all_summary(spark, sf_dir):
    daily = studies.top_daily(studies.keep_all_frame(spark, sf_dir), "clean", min_stocks=20)
    return rounded(evaluate.top_summary(daily), TOP, "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")


@query(O.query([*O.unified(), O.long_rows("unified", O.TOP_COLUMNS), O.eras(), O.top_days(20)], O.rounded(TOP, "summary", "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")))
def unified_summary(spark, sf_dir):
    daily = studies.top_daily(studies.unified_frame(spark, sf_dir), "unified", min_stocks=20)
    return rounded(evaluate.top_summary(daily), TOP, "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")


@query(O.query([*O.unified(), O.long_rows("price", O.TOP_COLUMNS), O.eras(), O.top_days(20)], O.rounded(TOP, "summary", "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")))
def price_summary(spark, sf_dir):
    daily = studies.top_daily(studies.unified_frame(spark, sf_dir), "price", min_stocks=20)
    return rounded(evaluate.top_summary(daily), TOP, "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")


PLAIN = "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon"


def _screen_sql(rules: dict) -> str:
    cases = " ".join(f"WHEN '{era}' THEN " + " AND ".join(f"{c} {'>=' if equal else '>'} CAST('{least}' AS DOUBLE)" for c, (least, equal) in wanted.items()) for era, wanted in rules.items())
    names = ", ".join(f"'{era}'" for era in rules)
    return f"""
judged AS (SELECT *, coalesce(CASE era {cases} END, false) AS met FROM summary WHERE era IN ({names})),
screen AS (SELECT factor, count_if(met) AS eras_met, min(edge) AS weakest_edge, min(signal_mean) AS weakest_signal_mean, min(signals) AS fewest_signals, count_if(met) = {len(rules)} AS qualifies FROM judged GROUP BY factor)"""


SCREENED = "factor, eras_met, fewest_signals, qualifies"
WEAKEST = "weakest_edge, weakest_signal_mean"


@query(O.query([*O.censored(), O.long_rows("stock", O.SIGNAL_COLUMNS), O.eras(), O.signal_days(20, 5), _screen_sql(screens.SCREENS["stock"])], O.rounded(WEAKEST, "screen", SCREENED)))
def stock_screen(spark, sf_dir):
    daily = studies.signal_daily(studies.censored_frame(spark, sf_dir), "stock", min_stocks=20, min_signals=5)
    return rounded(screens.screened(evaluate.positive_signal_summary(daily), screens.SCREENS["stock"]), WEAKEST, SCREENED)


@query(O.query([*O.censored(True), O.long_rows("followup", O.SIGNAL_COLUMNS), O.eras(), O.signal_days(20, 5), _screen_sql(screens.SCREENS["followup"])], O.rounded(WEAKEST, "screen", SCREENED)))
def followup_screen(spark, sf_dir):
    daily = studies.signal_daily(studies.censored_frame(spark, sf_dir, use_status=True), "followup", min_stocks=20, min_signals=5)
    return rounded(screens.screened(evaluate.positive_signal_summary(daily), screens.SCREENS["followup"]), WEAKEST, SCREENED)


def _five_eras(frame: str, study: str, rules: str) -> str:
    return O.query([*(O.keep_all() if frame == "clean" else O.unified()), O.long_rows(study, O.TOP_COLUMNS), O.eras(screens.FIVE_ERAS), O.top_days(20), _screen_sql(screens.SCREENS[rules])], O.rounded(WEAKEST, "screen", SCREENED))


@query(_five_eras("clean", "clean", "clean"))
def keep_all_screen(spark, sf_dir):
    summary = evaluate.top_summary(studies.top_daily(studies.keep_all_frame(spark, sf_dir), "clean", screens.FIVE_ERAS, min_stocks=20))
    return rounded(screens.screened(summary, screens.SCREENS["clean"]), WEAKEST, SCREENED)


@query(_five_eras("clean", "clean", "clean_ideal"))
def keep_all_ideal(spark, sf_dir):
    """Which factors the holdout bears out."""
    summary = evaluate.top_summary(studies.top_daily(studies.keep_all_frame(spark, sf_dir), "clean", screens.FIVE_ERAS, min_stocks=20))
    return rounded(screens.screened(summary, screens.SCREENS["clean_ideal"]), WEAKEST, SCREENED)


@query(_five_eras("unified", "unified", "unified"))
def unified_screen(spark, sf_dir):
    summary = evaluate.top_summary(studies.top_daily(studies.unified_frame(spark, sf_dir), "unified", screens.FIVE_ERAS, min_stocks=20))
    return rounded(screens.screened(summary, screens.SCREENS["unified"]), WEAKEST, SCREENED)


@query(O.query([*O.unified(), O.long_rows("price", O.TOP_COLUMNS), O.eras(), O.top_days(20), _screen_sql(screens.SCREENS["price"])], O.rounded(WEAKEST, "screen", SCREENED)))
def price_screen(spark, sf_dir):
    summary = evaluate.top_summary(studies.top_daily(studies.unified_frame(spark, sf_dir), "price", min_stocks=20))
    return rounded(screens.screened(summary, screens.SCREENS["price"]), WEAKEST, SCREENED)


POOLS = """
figures AS (SELECT factor, era, days, signals, round(signal_mean, 9) AS signal_mean, round(edge, 9) AS edge, rank_ic, rank_ic_days,
  CASE era WHEN 'train' THEN 60 WHEN 'valid' THEN 60 ELSE 30 END AS least FROM summary WHERE era <> 'holdout'),
pools AS (SELECT factor, min(signal_mean - 0.003) AS weakest_after_cost, min(edge) AS weakest_edge, CASE
    WHEN count_if(days >= least AND signals >= 500 AND signal_mean > 0.003 AND edge > 0.0015 AND rank_ic > 0.01 AND rank_ic_days >= least // 2) = 4 THEN 1
    WHEN count_if(days >= 20 AND signals >= 300 AND signal_mean > 0.003 AND edge > 0) = 4 THEN 2
    WHEN count_if(days >= 20 AND signals >= 300) = 4 THEN 3 END AS pool FROM figures GROUP BY factor)"""


@query(O.query([*O.keep_all(step=1), O.long_rows("clean", O.TOP_COLUMNS), O.eras(screens.FIVE_ERAS), O.top_days(5), POOLS],
               """SELECT factor, pool, pool_size, round(weakest_after_cost, 6) AS weakest_after_cost, round(weakest_edge, 6) AS weakest_edge
FROM (SELECT *, count(*) OVER (PARTITION BY pool) AS pool_size FROM pools WHERE pool IS NOT NULL)
ORDER BY pool, CASE WHEN pool < 3 THEN weakest_after_cost ELSE weakest_edge END DESC, CASE WHEN pool < 3 THEN weakest_edge ELSE weakest_after_cost END DESC, factor DESC LIMIT 1"""))
def keep_all_selection(spark, sf_dir):
    """The factor to lock, over every market day, so that eras of the test tables have days enough for some pool."""
    summary = evaluate.top_summary(studies.top_daily(studies.keep_all_frame(spark, sf_dir, step=1), "clean", screens.FIVE_ERAS, min_stocks=5))
    summary = summary.withColumns({c: F.round(c, 9) for c in ("signal_mean", "edge")})
    return rounded(screens.selected(summary, screens.SCREENS["clean"]), "weakest_after_cost, weakest_edge", "factor, pool, pool_size")


@query(O.query(O.censored(), "SELECT day, vt_symbol, exit_day, round(forward_return, 6) AS forward_return FROM frame WHERE recent_jump = 0 AND future_jump = 0"))
def jump_free_labels(spark, sf_dir):
    """The first study's labels as it filters them: no large jump in the features' or the label's days."""
    return rounded(studies.censored_frame(spark, sf_dir, use_jumps=True), "forward_return", "day, vt_symbol, exit_day")


def _boundary_sql() -> str:
    def summary(name: str, where: str) -> str:
        body = O.top_days(50, source=f"(SELECT * FROM in_era WHERE {where})")
        for word in ("ranked", "daily", "summary"):
            body = body.replace(f"{word} AS (", f"{word}_{name} AS (").replace(f"FROM {word} ", f"FROM {word}_{name} ")
        return body

    parts = [*O.keep_all(), O.long_rows("clean", O.TOP_COLUMNS), O.eras(clip=False), summary("a", "true"), summary("b", "exit_day <= era_end")]
    return O.query(parts, """SELECT c.factor, c.era, crossing_rows, a.days AS days_free, b.days AS days_clipped, round(a.edge, 6) AS edge_free, round(b.edge, 6) AS edge_clipped,
       NOT coalesce((a.edge IS NULL AND b.edge IS NULL) OR abs(a.edge - b.edge) <= 1e-9, false) AS changed
FROM (SELECT factor, era, count_if(exit_day > era_end) AS crossing_rows FROM in_era GROUP BY ALL) c
LEFT JOIN summary_a a USING (factor, era) LEFT JOIN summary_b b USING (factor, era)""")


@query(_boundary_sql())
def boundary_audit(spark, sf_dir):
    return rounded(studies.boundary(studies.keep_all_frame(spark, sf_dir), "clean"), "edge_free, edge_clipped", "factor, era, crossing_rows, days_free, days_clipped, changed")


def _offsets_sql() -> str:
    calendars = [O.schedule(f"schedule{k}", 6, k) for k in range(6)]
    union = "schedules AS (" + " UNION ALL ".join(f"SELECT *, 'offset {k}' AS era FROM schedule{k}" for k in range(6)) + ")"
    eligible = f"eligible AS (SELECT c.*, s.entry_day, s.exit_day, s.era FROM contexted c JOIN schedules s USING (day) WHERE {O.ELIGIBLE})"
    one = {"uptrend_pullback": factors.UNIFIED["uptrend_pullback"]}
    parts = [O.BARS, O.DAYS, O.MEMBERSHIP, O.panel(), O.MEMBERS, O.context("members", "contexted"), *calendars, union, eligible, O.labelled("eligible"),
             O.long_rows(one, O.TOP_COLUMNS + ", era"), "in_era AS (SELECT * FROM long WHERE isfinite(score))", O.top_days(50)]
    return O.query(parts, O.rounded(TOP, "summary", "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon"))


@query(_offsets_sql())
def offset_sensitivity(spark, sf_dir):
    return rounded(studies.offsets(spark, sf_dir), TOP, "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")


YEARS = [(str(y), f"{y}-01-01", f"{y}-12-31") for y in range(1995, 2002)]
DENSE = [*O.keep_all(step=1), O.long_rows({"market_down_day": factors.CLEAN["market_down_day"]}, O.TOP_COLUMNS), O.eras(YEARS), O.top_days(1)]
GRID = "grid AS (SELECT DISTINCT era, day FROM in_era),\ndense AS (SELECT g.era, g.day, signals, signal_mean, edge, signal_up_rate, entry_no_fills, unclosed FROM grid g LEFT JOIN daily d USING (era, day))"
DENSE_NUMBERS = "signal_mean, edge, median_signal_day_mean, signal_up_rate_mean, after_cost"


@query(O.query([*DENSE, GRID], f"""SELECT era, market_dates, signal_days, selected_stocks, selected_no_entry, selected_unclosed, {', '.join(f'round({n}, 6) AS {n}' for n in DENSE_NUMBERS.split(', '))} FROM (
  SELECT era, count(*) AS market_dates, count(signals) AS signal_days, CAST(coalesce(sum(signals), 0) AS BIGINT) AS selected_stocks, avg(signal_mean) AS signal_mean, avg(edge) AS edge,
         median(signal_mean) AS median_signal_day_mean, avg(signal_up_rate) AS signal_up_rate_mean, CAST(coalesce(sum(entry_no_fills), 0) AS BIGINT) AS selected_no_entry,
         CAST(coalesce(sum(unclosed), 0) AS BIGINT) AS selected_unclosed, avg(signal_mean) - 0.003 AS after_cost FROM dense GROUP BY era)"""))
def dense_day_audit(spark, sf_dir):
    return rounded(studies.dense_summary(studies.dense_days(spark, sf_dir)), DENSE_NUMBERS, "era, market_dates, signal_days, selected_stocks, selected_no_entry, selected_unclosed")


BOOT = """
series AS (SELECT era, day, signal_mean AS value, row_number() OVER (PARTITION BY era ORDER BY day) - 1 AS at, count(*) OVER (PARTITION BY era) AS n FROM dense),
sizes AS (SELECT era, max(n) AS n FROM series GROUP BY era HAVING max(n) >= 20),
drawn AS (SELECT era, n, r, b, i, ('0x' || substr(md5('7:' || r || ':' || b), 1, 8))::BIGINT % n AS start
  FROM sizes, range(4000) t(r), range(CAST(ceil(n / 10.0) AS BIGINT)) u(b), range(10) v(i) WHERE b * 10 + i < n),
means AS (SELECT d.era, r, avg(value) AS mean FROM drawn d JOIN series s ON s.era = d.era AND s.at = (d.start + d.i) % d.n GROUP BY d.era, r)"""


@query(O.query([*DENSE, GRID, BOOT], "SELECT era, count(mean) AS replicates, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM means GROUP BY era"))
def block_bootstrap(spark, sf_dir):
    series = studies.dense_days(spark, sf_dir).withColumnRenamed("signal_mean", "value")
    return rounded(bootstrap.intervals(series, block=10, seed=7), "low, high", "era, replicates")


@query()
def seeded_bootstrap(spark, sf_dir):
    series = studies.dense_days(spark, sf_dir).withColumnRenamed("signal_mean", "value")
    return rounded(bootstrap.seeded_intervals(series, block=10, seed=7, strict=False), "low, high", "era")


def _transfer_sql() -> str:
    one = {"ribbon_joint_widening": factors.PRICE["ribbon_joint_widening"]}
    rows = f"""
eligible AS (SELECT p.*, d.entry_day, d.exit_day FROM panel p JOIN daily_calendar d USING (day)
  WHERE l_suppkey % 3 = 0 AND {O.ELIGIBLE} AND isfinite(ma120) AND day IN (SELECT day FROM schedule))"""
    table = [*studies.ERAS, ("combined", studies.START, studies.END)]
    parts = [O.BARS, O.DAYS, O.panel(), O.schedule("daily_calendar", 1), O.schedule(), rows, O.labelled("eligible"), O.long_rows(one, O.TOP_COLUMNS), O.eras(table), O.top_days(5)]
    return O.query(parts, O.rounded(TOP, "summary", "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon"))


@query(_transfer_sql())
def transfer_test(spark, sf_dir):
    return rounded(studies.transfer(spark, sf_dir), TOP, "factor, era, days, signals, rank_ic_days, entry_no_fills, unclosed_at_horizon")


def _boot_sql(block: int, seed: int, value: str, name: str, keys: str = "era", source: str = "series") -> str:
    on = " AND ".join(f"d.{k} = s.{k}" for k in keys.split(", "))
    of = ", ".join(f"d.{k}" for k in keys.split(", "))
    return f"""
{name}_points AS (SELECT {keys}, {value} AS value, row_number() OVER (PARTITION BY {keys} ORDER BY day) - 1 AS at, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{name}_sizes AS (SELECT {keys}, max(n) AS n FROM {name}_points GROUP BY {keys} HAVING max(n) >= {2 * block}),
{name}_drawn AS (SELECT n, r, b, i, ('0x' || substr(md5('{seed}:' || r || ':' || b), 1, 8))::BIGINT % n AS start
  FROM (SELECT DISTINCT n FROM {name}_sizes), range(4000) t(r), range(CAST(ceil(n / {block}.0) AS BIGINT)) u(b), range({block}) v(i) WHERE b * {block} + i < n),
{name}_means AS (SELECT {of.replace('d.', 's.')}, r, avg(value) AS mean FROM {name}_drawn d JOIN {name}_points s ON s.n = d.n AND s.at = (d.start + d.i) % d.n GROUP BY ALL),
{name} AS (SELECT {keys}, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM {name}_means GROUP BY {keys})"""


def _transfer_audit_sql() -> list[str]:
    one = {"ribbon_joint_widening": factors.PRICE["ribbon_joint_widening"]}
    rows = f"eligible AS (SELECT p.*, d.entry_day, d.exit_day FROM panel p JOIN schedule d USING (day) WHERE l_suppkey % 3 = 0 AND {O.ELIGIBLE} AND isfinite(ma120))"
    periods = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in studies.TRANSFER_PERIODS)
    grid = f"grid AS (SELECT era, day FROM schedule JOIN (VALUES {periods}) e(era, a, b) ON day BETWEEN a AND b AND exit_day <= b)"
    series = "series AS (SELECT g.era, g.day, signal_mean, edge FROM grid g LEFT JOIN daily d ON d.era = g.era AND d.day = g.day)"
    audited = """
audited AS (SELECT s.*, own.low - 0.003 AS net_low, own.high - 0.003 AS net_high, edges.low AS block_edge_low, edges.high AS block_edge_high, grid_dates, signal_dates
  FROM summary s JOIN (SELECT era, count(*) AS grid_dates, count(signal_mean) AS signal_dates FROM series GROUP BY era) USING (era) LEFT JOIN own USING (era) LEFT JOIN edges USING (era))"""
    return [O.BARS, O.DAYS, O.panel(), O.schedule(step=1), rows, O.labelled("eligible"), O.long_rows(one, O.TOP_COLUMNS), O.eras(studies.TRANSFER_PERIODS), O.top_days(5), grid, series,
            _boot_sql(4, 24, "signal_mean", "own"), _boot_sql(4, 1024, "edge", "edges"), audited]


NET = "signal_mean, edge, net_low, net_high, block_edge_low, block_edge_high"


@query(O.query(_transfer_audit_sql(), O.rounded(NET, "audited", "factor, era, grid_dates, signal_dates, days, signals")))
def transfer_intervals(spark, sf_dir):
    """A locked rule on other symbols by period, on every market day, with its interval net of cost over the full grid of days."""
    return rounded(studies.transfer_audit(spark, sf_dir), NET, "factor, era, grid_dates, signal_dates, days, signals")


@query(O.query([*[p if not p.strip().startswith("audited") else p.replace("audited AS", "summary_ AS") for p in _transfer_audit_sql()], _screen_sql(screens.SCREENS["transfer"]).replace("FROM summary ", "FROM summary_ ").replace("CAST('-inf' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)")], O.rounded(WEAKEST, "screen", SCREENED)))
def transfer_screen(spark, sf_dir):
    """Whether the other symbols bear the rule out: means above cost in two periods, and over all of them an edge and a net interval above zero."""
    return rounded(screens.screened(studies.transfer_audit(spark, sf_dir), screens.SCREENS["transfer"]), WEAKEST, SCREENED)


def _round_sql() -> str:
    names = ", ".join(f"('{n}')" for n in factors.PRICE)
    grid = f"grid AS (SELECT DISTINCT factor, era, day FROM (SELECT DISTINCT era, day FROM frame JOIN (VALUES {', '.join(str((n, a, b)) for n, a, b in studies.ERAS)}) e(era, a, b) ON day BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) AND exit_day <= CAST(b AS DATE)), (VALUES {names}) f(factor))"
    series = "series AS (SELECT g.factor, g.era, g.day, signal_mean, edge FROM grid g LEFT JOIN daily d ON d.factor = g.factor AND d.era = g.era AND d.day = g.day)"
    parts = [*O.unified(), O.long_rows("price", O.TOP_COLUMNS), O.eras(), O.top_days(20), grid, series, _boot_sql(4, 24, "signal_mean", "own", "factor, era")]
    return O.query(parts, """SELECT factor, era, grid_dates, signal_dates, round(own.low - 0.003, 6) AS net_low, round(own.high - 0.003, 6) AS net_high
FROM (SELECT factor, era, count(*) AS grid_dates, count(signal_mean) AS signal_dates FROM series GROUP BY ALL) LEFT JOIN own USING (factor, era)""")


@query(_round_sql())
def price_intervals(spark, sf_dir):
    """The net interval of every price score in every era."""
    found = studies.round_intervals(studies.unified_frame(spark, sf_dir), "price")
    return rounded(found, "net_low, net_high", "factor, era, grid_dates, signal_dates")


#: A rule that the test tables have signals of.
SAMPLED = "uptrend_pullback"


def _sampling_sql() -> str:
    start, pool = studies.SAMPLED_FROM, studies.POOL_DAY
    anchor = f"(SELECT min(ordinal) FROM days WHERE day >= DATE '{start}')"
    calendar = f"""
calendar AS (SELECT 'history' AS anchor, day, entry_day, exit_day FROM schedule WHERE day >= DATE '{start}'
  UNION ALL SELECT 'period', day, entry_day, exit_day FROM days WHERE ordinal >= {anchor} AND (ordinal - {anchor}) % 6 = 0 AND day BETWEEN DATE '{start}' AND DATE '{studies.END}' AND exit_day <= DATE '{studies.END}'),
cases AS (SELECT anchor || '/moving' AS era, day, entry_day, exit_day, vt_symbol FROM calendar JOIN membership ON day BETWEEN member_start AND member_end
  UNION ALL SELECT anchor || '/fixed', day, entry_day, exit_day, vt_symbol FROM calendar, membership WHERE DATE '{pool}' BETWEEN member_start AND member_end),
rows_in AS (SELECT p.*, era, entry_day, exit_day FROM cases JOIN panel p USING (day, vt_symbol) WHERE {O.ELIGIBLE} AND isfinite(ma120))"""
    one = {SAMPLED: factors.UNIFIED[SAMPLED]}
    parts = [O.BARS, O.DAYS, O.MEMBERSHIP, O.panel(), O.schedule(), calendar, O.context("rows_in", "eligible").replace("PARTITION BY day", "PARTITION BY era, day"), O.labelled("eligible"),
             O.long_rows(one, O.TOP_COLUMNS + ", era"), "in_era AS (SELECT * FROM long WHERE isfinite(score))", O.top_days(20)]
    return O.query(parts, O.rounded(TOP, "summary", PLAIN))


@query(_sampling_sql())
def sampling_audit(spark, sf_dir):
    """One rule on two sampling anchors and two pools."""
    return rounded(studies.sampling_cases(spark, sf_dir, SAMPLED), TOP, PLAIN)


def _reselection_sql() -> str:
    variants = ["free", "clipped"]
    table = ", ".join(f"('{n}', '{v}', DATE '{a}', DATE '{b}')" for n, a, b in screens.FIVE_ERAS for v in variants)
    eras = f"in_era AS (SELECT l.*, era || '/' || variant AS era FROM long l JOIN (VALUES {table}) e(era, variant, a, b) ON day BETWEEN a AND b AND (variant = 'free' OR exit_day <= b) WHERE isfinite(score))"
    pools = POOLS.replace("SELECT factor, era, days", "SELECT factor, split_part(era, '/', 2) AS variant, split_part(era, '/', 1) AS era, days").replace("CASE era WHEN", "CASE split_part(era, '/', 1) WHEN")
    pools = pools.replace("WHERE era <> 'holdout'", "WHERE era NOT LIKE 'holdout%'").replace("pools AS (SELECT factor,", "pools AS (SELECT factor, variant,").replace("GROUP BY factor)", "GROUP BY factor, variant)")
    return O.query([*O.keep_all(step=1), O.long_rows("clean", O.TOP_COLUMNS), eras, O.top_days(5), pools], """
SELECT variant, factor, pool, pool_size, round(weakest_after_cost, 6) AS weakest_after_cost, round(weakest_edge, 6) AS weakest_edge
FROM (SELECT *, count(*) OVER (PARTITION BY variant, pool) AS pool_size FROM pools WHERE pool IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY variant ORDER BY pool, CASE WHEN pool < 3 THEN weakest_after_cost ELSE weakest_edge END DESC, CASE WHEN pool < 3 THEN weakest_edge ELSE weakest_after_cost END DESC, factor DESC) = 1""")


@query(_reselection_sql())
def boundary_reselection(spark, sf_dir):
    """The factor to lock with and without signals whose exit lies past their era."""
    summary = studies.boundary_summary(studies.keep_all_frame(spark, sf_dir, step=1), "clean", screens.FIVE_ERAS, min_stocks=5)
    summary = summary.withColumns({c: F.round(c, 9) for c in ("signal_mean", "edge")})
    return rounded(screens.selected_of_each(summary, screens.SCREENS["clean"], "variant"), "weakest_after_cost, weakest_edge", "variant, factor, pool, pool_size")


def _single_sql() -> str:
    over = "PARTITION BY vt_symbol ORDER BY day"
    above = f"above AS (SELECT *, CASE WHEN short_gap > 0 THEN 1.0 ELSE 0.0 END AS above, lead(open, 6) OVER ({over}) / nullif(lead(open, 1) OVER ({over}), 0) - 1 AS next FROM panel)"
    frame = "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
    shared = f"shared AS (SELECT *, CASE WHEN count(above) OVER ({over} {frame}) = 10 THEN avg(above) OVER ({over} {frame}) END AS above_share10 FROM above)"
    columns = ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS f_{n}" for n, x in factors.SINGLE.items())
    full = f"whole AS (SELECT vt_symbol, day, round(next, 9) AS target, {columns} FROM shared),\nfull_rows AS (SELECT * FROM whole WHERE target IS NOT NULL AND " + " AND ".join(f"f_{n} IS NOT NULL" for n in factors.SINGLE) + ")"
    numbered = f"numbered AS (SELECT *, row_number() OVER ({over}) - 1 AS k FROM full_rows),\nsampled AS (SELECT *, k // 6 AS number, count(*) OVER (PARTITION BY vt_symbol) AS size FROM numbered WHERE k % 6 = 0)"
    each = "unnest([" + ", ".join(f"{{'factor': '{n}', 'score': f_{n}}}" for n in factors.SINGLE) + "])"
    long = f"long AS (SELECT vt_symbol, day, target, CASE WHEN number < floor(size * 0.6::DOUBLE) THEN 'train' WHEN number < floor(size * 0.8::DOUBLE) THEN 'valid' ELSE 'test' END AS part, s.factor AS factor, s.score AS score FROM (SELECT *, {each} AS s FROM sampled))"
    rank = lambda x: f"rank() OVER (PARTITION BY vt_symbol, part, factor ORDER BY {x}) + (count(*) OVER (PARTITION BY vt_symbol, part, factor, {x}) - 1) / 2.0"
    ranked = f"ranked AS (SELECT *, {rank('score')} AS score_rank, {rank('target')} AS target_rank FROM long),\nics AS (SELECT vt_symbol, factor, part, count(*) AS n, round({O.CORR}, 9) AS ic FROM ranked GROUP BY ALL)"
    table = "result AS (SELECT vt_symbol, factor, " + ", ".join(f"coalesce(max(n) FILTER (part = '{p}'), 0) AS {p}_rows, max(ic) FILTER (part = '{p}') AS {p}_ic" for p in ("train", "valid", "test")) + " FROM ics GROUP BY ALL)"
    held = "coalesce(train_ic > 0 AND valid_ic > 0, false)"
    return O.query([O.BARS, O.panel(), above, shared, full, numbered, long, ranked, table],
                   f"SELECT vt_symbol, factor, train_rows, valid_rows, test_rows, round(train_ic, 6) AS train_ic, round(valid_ic, 6) AS valid_ic, round(test_ic, 6) AS test_ic, "
                   f"{held} AND row_number() OVER (PARTITION BY vt_symbol ORDER BY {held} DESC, valid_ic DESC NULLS LAST, factor) = 1 AS is_selected FROM result")  # fmt: skip


@query(_single_sql())
def single_series_study(spark, sf_dir):
    return rounded(studies.single_series(spark, sf_dir), "train_ic, valid_ic, test_ic", "vt_symbol, factor, train_rows, valid_rows, test_rows, is_selected")


@query(O.query([*O.unified(), O.long_rows("unified", O.TOP_COLUMNS), O.eras(), O.top_days(20)],
               "SELECT factor || '/' || era AS name, '| ' || factor || '/' || era || ' | ' || printf('%+.3f', round(edge, 6)) || ' | ' || coalesce(printf('%+.3f', round(rank_ic, 6)), 'n/a') || ' |' AS line FROM summary"))
def report_table(spark, sf_dir):
    summary = evaluate.top_summary(studies.top_daily(studies.unified_frame(spark, sf_dir), "unified", min_stocks=20))
    named = rounded(summary, "edge, rank_ic", "factor, era").withColumn("name", F.concat_ws("/", "factor", "era"))
    return files.report_lines(named, "name", ["edge", "rank_ic"])


# Data quality


def _figures_sql() -> str:
    measures = {"rows": "count(*)", "symbols": "count(DISTINCT vt_symbol)", "days": "count(DISTINCT day)", "invalid_ohlc": "count_if(high < greatest(open, low, close) OR low > least(open, high, close))",
                "zero_volume": "count_if(volume = 0)", "negative_volume": "count_if(volume < 0)", "weekend": "count_if(isodow(day) >= 6)", "vwap_outside": "count_if(vwap > high * 1.011 OR vwap < low * 0.989)"}
    for n in quality.NUMBERS:
        measures |= {f"null_{n}": f"count_if({n} IS NULL)", f"nonfinite_{n}": f"count_if(NOT isfinite({n}))", f"nonpositive_{n}": f"count_if({n} <= 0)"}
    return O.query([O.BARS], "UNPIVOT (SELECT " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in measures.items()) + " FROM bars) ON COLUMNS(*) INTO NAME measure VALUE value")


@query(_figures_sql())
def data_quality(spark, sf_dir):
    return quality.figures(B.bar_table(spark, sf_dir))


@query(O.query([O.BARS, O.panel()], "SELECT vt_symbol, day, round(day_return, 6) AS day_return FROM panel WHERE day_return IS NOT NULL ORDER BY abs(round(day_return, 6)) DESC, day, vt_symbol LIMIT 12"))
def largest_moves(spark, sf_dir):
    return quality.largest_moves(features.panel(B.bar_table(spark, sf_dir), features.STAGES[:2]))


@query(O.query([O.BARS], "SELECT vt_symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS rows, round(arg_min(close, day), 6) AS first_close, count(DISTINCT year(day)) AS years FROM bars GROUP BY vt_symbol"))
def symbol_coverage(spark, sf_dir):
    return quality.coverage(B.bar_table(spark, sf_dir)).withColumn("first_close", F.round("first_close", 6))


@query(O.query([O.BARS], "SELECT CAST(year(day) AS INT) AS year, count(*) AS rows, count(DISTINCT vt_symbol) AS symbols, count_if(volume = 0) AS zero_volume FROM bars GROUP BY 1"))
def yearly_rollup(spark, sf_dir):
    return quality.by_year(B.bar_table(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query("""SELECT l_partkey, day, round(average_rank, 1) AS average_rank FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day,
  rank() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_quantity) + (count(*) OVER (PARTITION BY CAST(l_shipdate AS DATE), l_quantity) - 1) / 2.0 AS average_rank FROM lineitem)""")
def average_ranks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    return rows.select("l_partkey", "day", F.round(average_rank("l_quantity", "day"), 1).alias("average_rank"))


# Documents and files


@query("""SELECT page_id, count(*) AS links, count(DISTINCT regexp_extract(href, '^[a-z]+://([^/?#]+)', 1)) AS hosts, min(href) AS first_link
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def page_links(spark, sf_dir):
    found = files.html_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("host").alias("hosts"), F.min("href").alias("first_link"))


@query("""SELECT l.href, count(DISTINCT l.page_id) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) l
WHERE l.href <> '' AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.href) GROUP BY l.href""")
def unindexed_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = files.html_links(pages).select("page_id", F.col("href").alias("file"))
    return files.broken_links(found, pages.select(F.col("url").alias("file"))).groupBy(F.col("file").alias("href")).agg(F.count_distinct("page_id").alias("pages"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS INT) AS bytes, sha256(html) AS sha256 FROM pages")
def page_manifest(spark, sf_dir):
    return files.manifest(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", F.col("html")).select("page_id", "bytes", "sha256")


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS account_key, coalesce(printf('%+.3f', c_acctbal), 'n/a') AS balance, replace(c_name, 'Customer', '***') AS shown FROM customer")
def redacted_accounts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.substring(F.sha2("c_name", 256), 1, 16)
    return rows.select("c_custkey", key.alias("account_key"), files.signed(F.col("c_acctbal")).alias("balance"), files.redacted(F.col("c_name"), ["Customer"]).alias("shown"))


# Ticks, rules and orders

TICKS = """
raw_ticks AS (SELECT user_id AS symbol, user_id % 4 AS product, ts, event_id AS seq, CASE WHEN isfinite(value) AND value > 0 AND value < 1e100 THEN value END AS price,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS volume, CAST(json_extract_string(props, '$.k') AS INT) AS detail, event_type FROM events)"""
STATS = """
signed_ticks AS (SELECT *, lag({'p': price, 'd': detail}) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM raw_ticks),
stats AS (SELECT symbol, product, count(*) AS ticks, count_if(before IS NOT NULL AND before IS DISTINCT FROM {'p': price, 'd': detail}) AS changes, arg_max(volume, seq) AS volume,
  arg_max(price, seq) AS last_price, arg_min(ts, seq) AS first_received, arg_max(ts, seq) AS last_received FROM signed_ticks GROUP BY ALL)"""
ORDERED = """
ordered AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM raw_ticks WHERE price IS NOT NULL) WHERE latest IS NULL OR ts > latest)"""


@query(O.query([TICKS, STATS], "SELECT * FROM stats"))
def tick_statistics(spark, sf_dir):
    return ticks.running_stats(ticks.ticks(spark, sf_dir))


@query(O.query([TICKS, STATS], "SELECT product, symbol, volume, ticks FROM stats WHERE ticks >= 2 AND changes >= 1 AND last_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product ORDER BY volume DESC, ticks DESC, symbol DESC) = 1"))
def most_active_symbols(spark, sf_dir):
    return ticks.most_active(ticks.running_stats(ticks.ticks(spark, sf_dir)))


@query(O.query([TICKS], "SELECT symbol, seq, ts, price, volume FROM raw_ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1"))
def latest_quotes(spark, sf_dir):
    return ticks.latest_quote(ticks.ticks(spark, sf_dir))


@query(O.query([TICKS, ORDERED, "crossed AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ordered)"],
               "SELECT symbol, seq, ts, before, price, CAST(50.0 AS DOUBLE) AS threshold FROM crossed WHERE before <= 50 AND price > 50"))
def threshold_crossings(spark, sf_dir):
    return ticks.crossings(ticks.ticks(spark, sf_dir), F.lit(50.0))


@query(O.query([TICKS, "ordered AS (SELECT *, detail % 7 <> 0 AS ready FROM (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM raw_ticks WHERE price IS NOT NULL) WHERE latest IS NULL OR ts > latest)",
                "crossed AS (SELECT *, lag(CASE WHEN ready THEN price END) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ordered)"],
               "SELECT symbol, seq, ts, before, price, CAST(50.0 AS DOUBLE) AS threshold FROM crossed WHERE ready AND before <= 50 AND price > 50"))
def gated_crossings(spark, sf_dir):
    """Crossings that a tick at which trading is not ready starts anew."""
    return ticks.crossings(ticks.ticks(spark, sf_dir), F.lit(50.0), F.col("detail") % 7 != 0)


@query("""SELECT l_orderkey AS order_id, min(l_shipdate) AS first_reported, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS status,
  arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS traded, count(*) AS reports FROM lineitem GROUP BY 1""")
def order_states(spark, sf_dir):
    """Sales lines as reports of their order: the latest state, and when the first one came."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("reported"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("traded"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ticks.order_states(rows, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query(O.query([TICKS, """
reports AS (SELECT CASE WHEN seq % 50 = 0 THEN 'product' ELSE 'symbol' END AS level, CASE WHEN seq % 50 = 0 THEN product ELSE symbol END AS name, seq, CAST(detail % 4 AS VARCHAR) AS status FROM raw_ticks)""",
                "latest AS (SELECT level, name, max(seq) AS seq, arg_max(status, seq) AS status FROM reports GROUP BY ALL)"],
               """SELECT i.symbol, i.product, CASE WHEN s.seq IS NULL OR p.seq > s.seq THEN p.status ELSE s.status END AS status,
  coalesce(CASE WHEN s.seq IS NULL OR p.seq > s.seq THEN p.status ELSE s.status END = '2', false) AS trading
FROM (SELECT DISTINCT symbol, product FROM raw_ticks) i LEFT JOIN latest s ON s.level = 'symbol' AND s.name = i.symbol LEFT JOIN latest p ON p.level = 'product' AND p.name = i.product"""))
def trading_status(spark, sf_dir):
    """Ticks as status reports, every fiftieth for a whole product."""
    rows = ticks.ticks(spark, sf_dir)
    whole = F.col("seq") % 50 == 0
    reports = rows.select(F.when(whole, "product").otherwise("symbol").alias("level"), F.when(whole, F.col("product")).otherwise(F.col("symbol")).alias("name"), "seq", (F.col("detail") % 4).cast("string").alias("status"))
    return ticks.trading_status(rows.select("symbol", "product").distinct(), reports)


@query(O.query([TICKS], "SELECT count(*) AS events, count(DISTINCT event_type) AS kinds, count(DISTINCT symbol) AS symbols, min(ts) AS first, max(ts) AS last, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM raw_ticks"))
def run_summary(spark, sf_dir):
    return files.run_summary(ticks.ticks(spark, sf_dir))


@query(O.query([TICKS], "SELECT symbol, arg_min(price, seq) AS first_price, round((round_even(arg_min(price, seq) / 0.01::DOUBLE, 0) + 2) * 0.01::DOUBLE, 6) AS threshold FROM raw_ticks WHERE price IS NOT NULL GROUP BY symbol"))
def anchored_thresholds(spark, sf_dir):
    return ticks.anchored_threshold(ticks.ticks(spark, sf_dir))


@query(O.query([TICKS, ORDERED, "islands AS (SELECT *, sum(CASE WHEN price > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ordered)"],
               "SELECT symbol, seq, ts, price FROM islands WHERE price > 30 QUALIFY row_number() OVER (PARTITION BY symbol, island ORDER BY seq) = 2"))
def two_tick_triggers(spark, sf_dir):
    return ticks.run_triggers(ticks.ticks(spark, sf_dir), F.lit(30.0))


@query("""SELECT product, place, instrument, expires FROM (
  SELECT p_brand AS product, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place, p_partkey AS instrument, CAST(DATE '1995-01-01' + to_months(p_size) AS DATE) AS expires
  FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND DATE '1995-01-01' + to_months(p_size) >= DATE '1996-06-01') WHERE place <= 6""")
def front_contracts(spark, sf_dir):
    return ticks.front_contracts(ticks.contracts(spark, sf_dir), "1996-06-01")


@query("""SELECT l_suppkey AS exchange, sum(q) AS position, count(*) AS trades, round(sum(amount), 2) AS amount FROM (
  SELECT l_suppkey, CAST(l_shipdate AS DATE), l_orderkey || '-' || l_linenumber AS trade_id, arg_min(l_quantity, (l_quantity, l_extendedprice)) AS q, arg_min(l_extendedprice, (l_quantity, l_extendedprice)) AS amount
  FROM lineitem WHERE l_partkey % 13 <> 0 GROUP BY 1, 2, 3) GROUP BY 1""")
def fill_positions(spark, sf_dir):
    return ticks.positions(ticks.fills(spark, sf_dir))


@query("""SELECT l_orderkey AS request_id, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS checksum FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1""")
def assembled_responses(spark, sf_dir):
    return ticks.assembled(ticks.responses(spark, sf_dir))


@query(O.query([TICKS], "SELECT product, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS ticks FROM raw_ticks WHERE price IS NOT NULL GROUP BY 1, 2"))
def hourly_bars(spark, sf_dir):
    return ticks.minute_bars(ticks.ticks(spark, sf_dir))


@query(O.query([TICKS], "SELECT event_type, count(*) AS events, count_if(price IS NULL) AS invalid FROM raw_ticks GROUP BY 1"))
def event_counts(spark, sf_dir):
    return ticks.event_counts(ticks.ticks(spark, sf_dir))


QUOTES = """
quotes AS (SELECT *, round(p - 0.1, 1) AS bid, round(CASE WHEN k % 7 = 0 THEN p - 0.2 WHEN k % 11 = 0 THEN p + 0.9 ELSE p + 0.1 END, 1) AS ask,
  round(p - CASE WHEN k % 31 = 0 THEN 0.1 ELSE 5 END, 1) AS lower, round(p + CASE WHEN k % 37 = 0 THEN -9 ELSE 5 END, 1) AS upper,
  CASE WHEN k % 29 <> 0 THEN p END AS last, CASE WHEN k % 41 <> 0 THEN k % 5 END AS bid_volume
  FROM (SELECT symbol, seq, detail AS k, round(price, 1) AS p FROM raw_ticks)),
grid AS (SELECT *, abs(last / 0.1 - round(last / 0.1)) < 1e-6 AND abs(bid / 0.1 - round(bid / 0.1)) < 1e-6 AND abs(ask / 0.1 - round(ask / 0.1)) < 1e-6 AS on_grid FROM quotes)"""


@query(O.query([TICKS, QUOTES], """SELECT symbol, seq, CASE
  WHEN k % 23 = 0 THEN 'invalid_tick_size' WHEN k % 19 = 0 THEN 'receive_stale' WHEN k % 17 = 0 THEN 'wrong_trading_day' WHEN k % 13 = 0 THEN 'exchange_stale_or_future'
  WHEN last IS NULL OR bid IS NULL OR ask IS NULL OR least(last, bid, ask, lower, upper) <= 0 THEN 'invalid_price' WHEN lower >= upper THEN 'invalid_limits'
  WHEN bid_volume IS NULL THEN 'incomplete_quote' WHEN bid_volume < 1 THEN 'empty_book'
  WHEN NOT on_grid OR last < lower OR last > upper OR bid < lower OR bid > upper OR ask < lower OR ask > upper THEN 'price_outside_limits_or_tick'
  WHEN bid > ask THEN 'crossed_book' WHEN ask - bid > 5 * 0.1::DOUBLE + 1e-8 THEN 'spread_too_wide' WHEN least(last - lower, upper - last, bid - lower, upper - ask) < 2 * 0.1::DOUBLE - 1e-8 THEN 'near_price_limit' ELSE '' END AS reason
FROM grid"""))
def quote_checks(spark, sf_dir):
    return rules.quotes(ticks.ticks(spark, sf_dir)).select("symbol", "seq", rules.quote_reason().alias("reason"))


def _sessions_sql() -> str:
    spans = [("isodow(ts) < 6", *s) for s in rules.SESSIONS] + [("isodow(ts) < 6", *rules.NIGHT), ("isodow(ts - INTERVAL 1 DAY) < 6", 0, rules.NIGHT[1] - 86400)]
    cases = " ".join(f"WHEN {day} AND s >= {a} AND s < {b} THEN {b} - s" for day, a, b in spans)
    return f"SELECT event_id, round(CASE {cases} ELSE 0 END, 6) AS seconds FROM (SELECT event_id, ts, epoch(ts - date_trunc('day', ts)) AS s FROM events)"


@query(_sessions_sql().replace("epoch(ts - date_trunc('day', ts))", "hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1000000.0"))
def session_seconds(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.round(rules.seconds_to_break(F.col("ts")), 6).alias("seconds"))


ENTRY = """
risk AS (SELECT c_custkey, 'SHFE' AS exchange, CASE WHEN c_custkey % 9 = 0 THEN 'cu' ELSE 'au' END AS product, 1.0 AS step, 10.0 AS multiplier, c_custkey % 7 = 0 AS has_position, c_custkey % 11 = 0 AS has_order,
  CASE WHEN c_custkey % 13 = 0 THEN 'USD' ELSE 'CNY' END AS currency, c_acctbal * 100 AS balance, c_acctbal * 90 AS available, CAST(c_custkey % 50 * 10 AS DOUBLE) AS max_loss,
  (1000.0 + c_custkey % 100) * 10 * 0.14 AS margin, 4.0 AS fee FROM customer)"""


@query(O.query([ENTRY], """SELECT c_custkey, round(margin, 6) AS estimated_margin, CASE WHEN product = 'cu' THEN 'unsupported_contract' WHEN has_position THEN 'existing_position_or_frozen' WHEN has_order THEN 'existing_working_order'
  WHEN currency <> 'CNY' THEN 'wrong_currency' WHEN balance <= 0 OR available <= 0 OR max_loss <= 0 THEN 'invalid_funds' WHEN margin > 0.1 * balance THEN 'margin_exceeds_10_percent_equity'
  WHEN available < 1.2 * margin + 2 * fee + max_loss THEN 'insufficient_available' WHEN max_loss < fee + 2 * step * multiplier THEN 'loss_budget_below_cost_buffer' ELSE '' END AS reason FROM risk"""))
def entry_checks(spark, sf_dir):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.lit("SHFE").alias("exchange"), F.when(k % 9 == 0, "cu").otherwise("au").alias("product"), F.lit("1").alias("product_class"), F.lit(True).alias("tradable"),
        F.lit(1.0).alias("step"), F.lit(10.0).alias("multiplier"), (k % 7 == 0).cast("int").alias("open_positions"), (k % 11 == 0).cast("int").alias("working_orders"),
        F.when(k % 13 == 0, "USD").otherwise("CNY").alias("currency"), (F.col("c_acctbal") * 100).alias("balance"), (F.col("c_acctbal") * 90).alias("available"),
        (k % 50 * 10).cast("double").alias("max_loss"), (F.lit(1000.0) + k % 100).alias("upper"), F.lit(0.14).alias("margin_by_money"), F.lit(0.0).alias("margin_by_volume"),
        *[F.lit(x).alias(n) for n, x in (("open_by_money", 0.0), ("close_by_money", 0.0), ("open_by_volume", 2.0), ("close_by_volume", 2.0))],
    )
    rows = rows.withColumns(rules.costs())
    return rows.select("c_custkey", F.round("estimated_margin", 6).alias("estimated_margin"), rules.entry_reason().alias("reason"))


#: The rules of the order life cycle as a recursion over each run's events: one level of queries for what an event does, one for the limits that have passed.
LIFECYCLE = """
WITH RECURSIVE """ + TICKS.strip() + """,
log AS (SELECT CAST(symbol AS VARCHAR) AS run, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n, floor(epoch(ts)) AS now, price, detail % 7 <> 0 AS ready,
  CASE WHEN detail % 9 = 0 THEN 'order' WHEN detail % 9 = 1 THEN 'trade' WHEN detail = 50 THEN 'disconnect' WHEN detail % 31 = 0 THEN 'flat' ELSE 'quote' END AS kind,
  CASE WHEN detail % 2 = 0 THEN 'open' ELSE 'close' END AS role, CASE WHEN detail % 4 = 0 THEN '5' ELSE '3' END AS reported FROM raw_ticks WHERE price IS NOT NULL),
states AS (
  SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, 'waiting' AS phase, '' AS frozen, CAST(NULL AS DOUBLE) AS threshold, 0 AS above, CAST(NULL AS DOUBLE) AS open_price, CAST(NULL AS DOUBLE) AS filled_at,
    CAST(NULL AS DOUBLE) AS sent_at, '' AS status, CAST(NULL AS DOUBLE) AS cancel_at, '' AS signal, '' AS shown, 0 AS intents, CAST(NULL AS VARCHAR) AS close_reason FROM log
  UNION ALL
  SELECT run, n, phase_2, CASE WHEN frozen_2 <> '' THEN frozen_2 WHEN late THEN 'no acknowledgement' WHEN lost THEN 'cancel not acknowledged' ELSE '' END, threshold_2, above_2, open_price_2, filled_at_2, sent_2, status_2, cancel_3, signal_2,
    CASE WHEN acted OR asked OR (frozen_2 = '' AND (late OR lost)) THEN phase_2 ELSE shown END, intents + CASE WHEN sends_open OR sends_close THEN 1 ELSE 0 END, CASE WHEN sends_close THEN signal_2 ELSE close_reason END
  FROM (
    SELECT *, pending AND cancel_3 IS NOT NULL AND now - cancel_3 > 5 AND status_2 NOT IN ('0', '2', '4', '5') AS lost FROM (
      SELECT *, CASE WHEN asked THEN now ELSE cancel_2 END AS cancel_3 FROM (
        SELECT *, pending AND status_2 = '' AND now - sent_2 > 3 AS late, coalesce(pending AND status_2 IN ('1', '3') AND now - sent_2 > 10 AND cancel_2 IS NULL, false) AS asked FROM (
          SELECT *, alive AND phase_2 IN ('open_pending', 'close_pending') AS pending, frozen_2 <> frozen OR (can AND threshold IS NULL) OR sends_open OR sends_close OR (ended AND role = 'open') OR filled OR flat AS acted FROM (
            SELECT *, CASE WHEN sends_open THEN 'open_pending' WHEN sends_close THEN 'close_pending' WHEN ended AND role = 'open' THEN 'canceled' WHEN filled AND role = 'open' THEN 'holding'
                WHEN filled THEN 'verifying_flat' WHEN flat THEN 'closed' ELSE phase END AS phase_2,
              CASE WHEN frozen <> '' THEN frozen WHEN alive AND kind = 'disconnect' THEN 'disconnected' WHEN ended AND role = 'close' THEN 'close order ended without a fill'
                WHEN alive AND kind = 'trade' AND NOT filled THEN 'unexpected fill' ELSE '' END AS frozen_2,
              CASE WHEN filled AND role = 'open' THEN price ELSE open_price END AS open_price_2, CASE WHEN filled AND role = 'open' THEN now ELSE filled_at END AS filled_at_2,
              CASE WHEN sends_open OR sends_close THEN now ELSE sent_at END AS sent_2, CASE WHEN sends_open OR sends_close THEN '' WHEN told THEN reported ELSE status END AS status_2,
              CASE WHEN NOT (sends_open OR sends_close) THEN cancel_at END AS cancel_2 FROM (
              SELECT *, can AND above_2 >= 2 AS sends_open, holds AND signal_2 <> '' AND ready AS sends_close, told AND reported IN ('2', '4', '5') AS ended FROM (
                SELECT *, CASE WHEN alive AND kind = 'disconnect' THEN 0 WHEN alive AND kind = 'quote' AND phase = 'waiting' THEN CASE WHEN can AND price > threshold_2 THEN above + 1 ELSE 0 END ELSE above END AS above_2,
                  CASE WHEN NOT holds THEN signal WHEN price - 0.1::DOUBLE - open_price <= -5 THEN 'stop_loss' WHEN signal <> '' THEN signal WHEN now - filled_at >= 60 THEN 'time_limit' ELSE '' END AS signal_2 FROM (
                  SELECT *, CASE WHEN can AND threshold IS NULL THEN round((round_even(price / 0.1::DOUBLE, 0) + 2) * 0.1::DOUBLE, 8) ELSE threshold END AS threshold_2 FROM (
                    SELECT s.* EXCLUDE (n), e.* EXCLUDE (run), phase NOT IN ('closed', 'canceled') AS alive, kind = 'quote' AND phase = 'waiting' AND ready AND frozen = '' AS can,
                      kind = 'quote' AND phase = 'holding' AND frozen = '' AS holds, kind = 'order' AND phase = role || '_pending' AS told, kind = 'trade' AND phase = role || '_pending' AS filled,
                      kind = 'flat' AND phase = 'verifying_flat' AND frozen = '' AS flat
                    FROM states s JOIN log e ON e.run = s.run AND e.n = s.n + 1))))))))))
SELECT run, shown AS phase, CAST(intents AS BIGINT) AS intents, nullif(frozen, '') AS frozen, close_reason FROM (
  SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1) WHERE shown <> ''"""


@query(LIFECYCLE)
def order_lifecycles(spark, sf_dir):
    """Every user's events as the log of one experiment, replayed through the state machine."""
    k = F.col("detail")
    rows = ticks.ticks(spark, sf_dir).where("price IS NOT NULL")
    kind = F.when(k % 9 == 0, "order").when(k % 9 == 1, "trade").when(k == 50, "disconnect").when(k % 31 == 0, "flat").otherwise("quote")
    role = F.when(k % 2 == 0, "open").otherwise("close")
    log = rows.select(
        F.col("symbol").cast("string").alias("run"), "seq", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("mono"), kind.alias("kind"), role.alias("role"),
        F.when(k % 4 == 0, "5").otherwise("3").alias("status"), F.col("seq").cast("string").alias("trade_id"), "price", F.when(kind == "trade", 1).otherwise(0).alias("volume"),
        F.col("price").alias("last"), (F.col("price") - 0.1).alias("bid"), (F.col("price") + 0.1).alias("ask"), (k % 7 != 0).alias("ready"), F.lit(900.0).alias("seconds_left"),
    )
    return lifecycle.summary(lifecycle.replay(log))


# Sources, over files that Spark derives from the tables


@query(O.query([O.BARS], "SELECT vt_symbol, day, open, close, volume, tradestatus, is_st FROM bars WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND l_suppkey % 2 = 0"))
def provider_bars(spark, sf_dir):
    """Bars of every second symbol and some years from payload files, a partition for each TOGETHER symbols, the dates pushed to the source."""
    path = files.scratch(spark, "provider")
    bars = B.bar_table(spark, sf_dir)
    provider.write_payloads(bars, path)
    provider.register(spark)
    codes = [f"S{k}" for k in sorted(r[0] for r in bars.where("l_suppkey % 2 = 0").select("l_suppkey").distinct().collect())]  # what a download is asked for
    got = spark.read.format("provider_bars").option("path", path).option("codes", json.dumps(codes)).option("least", "1").option("together", provider.TOGETHER).load()
    got = got.where(F.col("day").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))
    return got.select("vt_symbol", "day", "open", "close", "volume", "tradestatus", "is_st")


@query(O.query([O.BARS], "SELECT vt_symbol, count(*) AS rows, min(day) AS first_day, max(day) AS last_day, round(sum(turnover), 2) AS turnover FROM bars GROUP BY vt_symbol"))
def arrow_cache_coverage(spark, sf_dir):
    """The coverage of a cache of Arrow streams, each of them read in a task."""
    arrow.shipped(spark)
    bars = B.weekly_bars(spark, sf_dir)
    path = files.scratch(spark, "arrow-cache")
    arrow.encoded(bars).write.parquet(path)
    cached = arrow.decoded(spark.read.parquet(path), "stream", bars.schema)
    return cached.groupBy("vt_symbol").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.sum("turnover"), 2).alias("turnover"))


@query(O.query([O.BARS], """SELECT vt_symbol, day, close, volume FROM bars WHERE day <= DATE '1998-12-28'"""))
def point_in_time_bars(spark, sf_dir):
    """Bars as the first of two versions had them, up to a day: the second version's revisions do not show."""
    path = files.scratch(spark, "versions")
    bars = B.weekly_bars(spark, sf_dir).select("vt_symbol", "day", "close", "volume")
    files.publish(bars, path)
    files.publish(bars.withColumn("close", F.col("close") * 2), path)
    return files.known_by(spark, path, 1, "1998-12-28")


@query(O.query([O.BARS, O.MEMBERSHIP], """SELECT b.vt_symbol, b.day, close, member_start FROM bars b JOIN (SELECT vt_symbol, min(member_start) AS member_start FROM membership GROUP BY vt_symbol) m ON m.vt_symbol = b.vt_symbol"""))
def checked_attachment(spark, sf_dir):
    """Every bar with its symbol's first membership day, published only if each has exactly one: checked while it is written."""
    path = files.scratch(spark, "attached")
    facts = B.membership(spark, sf_dir).groupBy("vt_symbol").agg(F.min("member_start").alias("member_start"))
    checks.attached(B.weekly_bars(spark, sf_dir).select("vt_symbol", "day", "close"), facts, ["vt_symbol"]).publish(path)
    return files.published(spark, path)


@query("""
WITH refs AS (SELECT 'parts_' || (p_partkey // 100) || '.py' AS file, CASE WHEN p_partkey % 11 = 0 THEN 'Parts.gone_' ELSE 'Parts.part_' END || p_partkey AS symbol,
  CAST(3 * row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS BIGINT) AS now, p_partkey FROM part)
SELECT file, symbol, now + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS line, CASE WHEN p_partkey % 11 <> 0 THEN now END AS now, CASE WHEN p_partkey % 11 = 0 THEN 'invalid' ELSE 'moved' END AS reason
FROM refs WHERE p_partkey % 11 = 0 OR p_partkey % 5 = 0""")
def reference_drift(spark, sf_dir):
    """Parts as methods of source files of a hundred each, and references to them of which some are off by a line or have no symbol."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("parts_"), F.floor(F.col("p_partkey") / 100).cast("string"), F.lit(".py")).alias("file"), "p_size")
    method = F.concat(F.lit("    def part_"), F.col("p_partkey").cast("string"), F.lit("(self):\n        return "), F.col("p_size").cast("string"), F.lit("\n\n"))
    held = F.sort_array(F.collect_list(F.struct("p_partkey", method.alias("code"))))  # a hundred at most
    sources = part.groupBy("file").agg(F.concat(F.lit("class Parts:\n"), F.array_join(F.transform(held, lambda m: m["code"]), "")).alias("text"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("p_partkey"))
    symbol = F.concat(F.when(F.col("p_partkey") % 11 == 0, "Parts.gone_").otherwise("Parts.part_"), F.col("p_partkey").cast("string"))
    pinned = part.select("file", symbol.alias("symbol"), (3 * place - 1 + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).cast("long").alias("line"))
    return code.drifted_references(pinned, code.symbols(sources))


# Routing of events


@query("""
WITH intents AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'close' END AS role, o_orderkey % 50 AS instrument, o_orderkey AS order_ref, o_orderkey % 3 AS front, o_orderkey % 7 AS session,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 10 END AS sys_id FROM orders WHERE o_orderkey % 9 <> 0),
reports AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 50 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS instrument, l_orderkey AS order_ref,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey % 3 + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END END AS front, l_orderkey % 7 AS session,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_orderkey * 10 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END END AS sys_id FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, role FROM reports r LEFT JOIN intents i ON r.instrument = i.instrument AND r.order_ref = i.order_ref
  AND (r.front IS NULL OR (r.front IS NOT DISTINCT FROM i.front AND r.session IS NOT DISTINCT FROM i.session)) AND (i.sys_id IS NULL OR coalesce(r.sys_id = i.sys_id, false))""")
def order_owners(spark, sf_dir):
    """Sales lines as reports of orders, met with the orders as intents."""
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    intents = spark.read.parquet(f"{sf_dir}/orders.parquet").where(o % 9 != 0).select(
        F.when(o % 2 == 0, "open").otherwise("close").alias("role"), (o % 50).alias("instrument"), o.alias("order_ref"), (o % 3).alias("front"), (o % 7).alias("session"), F.when(o % 5 != 0, o * 10).alias("sys_id")
    )
    k = F.col("l_orderkey")
    reports = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", (k % 50 + F.when(n == 7, 1).otherwise(0)).alias("instrument"), k.alias("order_ref"), F.when(n % 3 != 0, k % 3 + F.when(n == 5, 1).otherwise(0)).alias("front"),
        (k % 7).alias("session"), F.when(n % 4 != 0, k * 10 + F.when(n == 6, 1).otherwise(0)).alias("sys_id"),
    )
    return routing.owners(reports, intents).select("l_orderkey", "l_linenumber", "l_partkey", "role")


@query("""
SELECT 'tick' AS kind, CAST(user_id AS BIGINT) AS symbol, NULL::BIGINT AS request_id, count(*) AS events FROM events WHERE user_id % 3 = 0 GROUP BY ALL
UNION ALL SELECT 'answer', NULL, CAST(l_orderkey AS BIGINT), count(*) FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY ALL""")
def routed_events(spark, sf_dir):
    """Ticks and messages as one stream of events, of which those of the symbols and requests that are waited for stay."""
    market = ticks.ticks(spark, sf_dir).select("symbol", F.lit("tick").alias("kind"))
    trading = ticks.responses(spark, sf_dir).select("request_id", F.lit("answer").alias("kind"))
    events = routing.one_stream(market, trading)
    symbols = market.where("symbol % 3 = 0").select("symbol")
    requests = trading.where("request_id % 4 = 0").select("request_id")
    return routing.wanted(events, symbols, requests).groupBy("kind", "symbol", "request_id").agg(F.count("*").alias("events"))


@query(O.query([TICKS, STATS], """SELECT c.symbol, ticks, changes, coalesce(changes > 0, false) AS verified
FROM (SELECT DISTINCT user_id AS symbol FROM events WHERE user_id % 5 = 0 UNION SELECT -1) c LEFT JOIN stats s ON s.symbol = c.symbol"""))
def verified_symbols(spark, sf_dir):
    """Every fifth symbol and one that nobody knows, with what came of them."""
    rows = ticks.ticks(spark, sf_dir)
    selected = rows.where("symbol % 5 = 0").select("symbol").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("symbol")))
    return routing.verified(selected, ticks.running_stats(rows))


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_linenumber % 3, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS l_linenumber, arg_max(l_partkey, (l_linenumber % 3, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS l_partkey,
  arg_max(l_linestatus, (l_linenumber % 3, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS l_linestatus FROM lineitem GROUP BY 1""")
def merged_journal(spark, sf_dir):
    """Sales lines as three batches of order reports, each merged into a journal that has the last report of an order."""
    path = files.scratch(spark, "journal")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    write = journal.merging(path, ["l_orderkey"], order=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], buckets=8)
    for number in range(3):
        write(rows.where(F.col("l_linenumber") % 3 == number), number)
    return journal.journal(spark, path, rows.schema).select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
