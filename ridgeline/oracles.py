"""SQL for the registered queries, written for an independent engine: common table expressions put together as text."""

from __future__ import annotations

from ridgeline.plans import factors, features
from ridgeline.plans.studies import END, ERAS, START

BARS = """
sales AS (SELECT *, l_extendedprice / l_quantity AS price, CAST(date_trunc('week', l_shipdate) AS DATE) AS day FROM lineitem),
bars AS (
  SELECT 'S' || l_suppkey AS vt_symbol, l_suppkey, day,
         arg_min(price, (l_shipdate, l_orderkey, l_linenumber, price)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (l_shipdate, l_orderkey, l_linenumber, price)) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS turnover, round(sum(l_extendedprice), 2) / nullif(sum(l_quantity), 0) AS vwap,
         CASE WHEN sum(l_quantity) < 5 THEN 0 ELSE 1 END AS tradestatus, coalesce(max(CAST(s_acctbal < 0 AS INT)), 0) AS is_st
  FROM sales LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, day)"""

DAYS = """
days AS (
  SELECT day, row_number() OVER (ORDER BY day) - 1 AS ordinal, lead(day, 1) OVER (ORDER BY day) AS entry_day, lead(day, 6) OVER (ORDER BY day) AS exit_day
  FROM (SELECT DISTINCT day FROM bars))"""

MEMBERSHIP = """
spans AS (
  SELECT 'S' || s_suppkey AS vt_symbol, s_suppkey, CAST(DATE '1995-01-02' + CAST(s_suppkey % 5 * 90 AS INT) AS DATE) AS member_start FROM supplier),
membership AS (
  SELECT vt_symbol, member_start, CASE WHEN s_suppkey % 7 = 0 THEN CAST(member_start + 1400 AS DATE) ELSE DATE '2001-12-31' END AS member_end FROM spans
  UNION ALL SELECT vt_symbol, CAST(member_start + 1500 AS DATE), DATE '2001-12-31' FROM spans WHERE s_suppkey % 7 = 0)"""


def schedule(name: str = "schedule", step: int = 6, offset: int = 0) -> str:
    anchor = f"(SELECT min(ordinal) FROM days WHERE day >= DATE '{START}') + {offset}"
    return f"""
{name} AS (
  SELECT day, entry_day, exit_day, ordinal FROM days
  WHERE ordinal >= {anchor} AND (ordinal - ({anchor})) % {step} = 0 AND day BETWEEN DATE '{START}' AND DATE '{END}' AND exit_day <= DATE '{END}')"""


def panel() -> str:
    def made(spec) -> str:
        if isinstance(spec, str):
            return spec
        kind, *rest = spec
        over = "PARTITION BY vt_symbol ORDER BY day"
        if kind == "roll":
            how, column, n, ending = rest
            frame = f"({over} ROWS BETWEEN {n - 1 + ending} PRECEDING AND {f'{ending} PRECEDING' if ending else 'CURRENT ROW'})"
            return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {'stddev_samp' if how == 'stddev' else how}({column}) OVER {frame} END"
        column, n = rest
        if kind == "lag":
            return f"lag({column}, {n}) OVER ({over})"
        return f"coalesce(max({column}) OVER ({over} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), 0)"

    parts, last = [], "bars"
    for k, stage in enumerate(features.STAGES):
        parts.append(f"panel{k} AS (SELECT *, " + ", ".join(f"{made(s)} AS {n}" for n, s in stage.items()) + f" FROM {last})")
        last = f"panel{k}"
    return ",\n".join([*parts, f"panel AS (SELECT * FROM {last})"])


MEMBERS = """
members AS (SELECT p.* FROM panel p JOIN membership m ON p.vt_symbol = m.vt_symbol AND p.day BETWEEN member_start AND member_end)"""


def context(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, avg(over_ma20) OVER (PARTITION BY day) AS breadth20, avg(above_short) OVER (PARTITION BY day) AS breadth_gap,
         round(avg(day_return) OVER (PARTITION BY day), 12) AS market_return, median(sd20) OVER (PARTITION BY day) AS vol_median FROM {source})"""


ELIGIBLE = "close > 0 AND volume > 0 AND tradestatus = 1 AND is_st = 0 AND isfinite(long_gap) AND isfinite(depth5)"


def labelled(source: str, name: str = "frame") -> str:
    def side(s: str) -> str:
        return f"LEFT JOIN bars {s} ON {s}.vt_symbol = x.vt_symbol AND {s}.day = x.{s}_day"

    fill = lambda s: f"coalesce({s}.open > 0 AND {s}.volume > 0 AND {s}.tradestatus = 1, false)"
    return f"""
{name}_joined AS (
  SELECT x.*, {fill('entry')} AS entry_fill, {fill('exit')} AS exit_fill, entry.open AS entry_open, exit.open AS exit_open, marks.close AS mark_close
  FROM {source} x {side('entry')} {side('exit')} ASOF LEFT JOIN bars marks ON marks.vt_symbol = x.vt_symbol AND marks.day <= x.exit_day),
{name} AS (
  SELECT *, CASE WHEN NOT entry_fill THEN 0.0 WHEN NOT exit_fill THEN mark_close / nullif(entry_open, 0) - 1 ELSE exit_open / nullif(entry_open, 0) - 1 END AS intent_return,
         CASE WHEN NOT entry_fill THEN 0.0 WHEN NOT exit_fill THEN -1.0 ELSE exit_open / nullif(entry_open, 0) - 1 END AS worst_case_return,
         entry_fill AND NOT exit_fill AS unclosed_at_horizon
  FROM {name}_joined)"""


def keep_all(step: int = 6, offset: int = 0) -> list[str]:
    eligible = f"eligible AS (SELECT c.*, entry_day, exit_day FROM contexted c JOIN schedule USING (day) WHERE {ELIGIBLE})"
    return [BARS, DAYS, MEMBERSHIP, panel(), MEMBERS, context("members", "contexted"), schedule(step=step, offset=offset), eligible, labelled("eligible")]


def unified() -> list[str]:
    snapshot = "snapshot AS (SELECT day, vt_symbol, entry_day, exit_day FROM schedule JOIN membership ON day BETWEEN member_start AND member_end)"
    rows = f"rows_in AS (SELECT p.*, entry_day, exit_day FROM snapshot JOIN panel p USING (day, vt_symbol) WHERE {ELIGIBLE} AND isfinite(ma120))"
    return [BARS, DAYS, MEMBERSHIP, panel(), schedule(), snapshot, rows, context("rows_in", "eligible"), labelled("eligible")]


def censored(use_status: bool = False) -> list[str]:
    more = " AND x.tradestatus = 1 AND x.is_st = 0 AND entry.tradestatus = 1 AND exit.tradestatus = 1" if use_status else ""
    rows = f"""
frame AS (
  SELECT x.*, s.exit_day, exit.open / nullif(entry.open, 0) - 1 AS forward_return
  FROM contexted x JOIN schedule s USING (day)
  JOIN bars entry ON entry.vt_symbol = x.vt_symbol AND entry.day = s.entry_day JOIN bars exit ON exit.vt_symbol = x.vt_symbol AND exit.day = s.exit_day
  WHERE x.volume > 0 AND entry.volume > 0 AND exit.volume > 0 AND exit.open / nullif(entry.open, 0) IS NOT NULL{more})"""
    return [BARS, DAYS, MEMBERSHIP, panel(), MEMBERS, context("members", "contexted"), schedule(), rows]


def query(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def wide(study: str) -> str:
    return "SELECT day, vt_symbol, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {n}" for n, x in factors.STUDIES[study].items()) + " FROM frame"


def long_rows(study: str | dict, columns: str, source: str = "frame") -> str:
    wanted = factors.STUDIES[study] if isinstance(study, str) else study
    scored = f"scored AS (SELECT {columns}, " + ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS f_{n}" for n, x in wanted.items()) + f" FROM {source})"
    each = "unnest([" + ", ".join(f"{{'factor': '{n}', 'score': f_{n}}}" for n in wanted) + "])"
    return f"{scored},\nlong AS (SELECT {columns}, s.factor, s.score FROM (SELECT {columns}, {each} AS s FROM scored))"


def eras(table=ERAS, clip: bool = True, source: str = "long") -> str:
    values = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in table)
    clipped = " AND exit_day <= era_end" if clip else ""
    return f"in_era AS (SELECT l.*, era, era_end FROM {source} l JOIN (VALUES {values}) e(era, era_start, era_end) ON day BETWEEN era_start AND era_end{clipped} WHERE isfinite(score))"


def ranks(target: str, source: str) -> str:
    out = []
    for name, x in (("score_rank", "score"), ("target_rank", target)):
        out.append(f"rank() OVER (PARTITION BY factor, era, day ORDER BY {x}) + (count(*) OVER (PARTITION BY factor, era, day, {x}) - 1) / 2.0 AS {name}")
    return f"SELECT *, {', '.join(out)} FROM {source}"


CORR = "covar_samp(score_rank, target_rank) / nullif(stddev_samp(score_rank) * stddev_samp(target_rank), 0)"


def signal_days(min_stocks: int = 50, min_signals: int = 20) -> str:
    return f"""
ranked AS ({ranks('target', '(SELECT *, round(forward_return, 9) AS target FROM in_era)')}),
daily AS (
  SELECT *, round(signal_mean - baseline_mean, 9) AS edge FROM (
    SELECT factor, era, day, count(*) AS stocks, count(*) FILTER (score > 0) AS signals, avg(target) AS baseline_mean, avg(target) FILTER (score > 0) AS signal_mean,
           avg(CAST(target > 0 AS INT)) FILTER (score > 0) AS signal_up_rate, avg(CAST(target > 0 AS INT)) AS baseline_up_rate, {CORR} AS rank_ic
    FROM ranked GROUP BY ALL)
  WHERE stocks >= {min_stocks} AND signals >= {min_signals} AND rank_ic IS NOT NULL),
summary AS (
  SELECT factor, era, count(*) AS days, CAST(sum(signals) AS BIGINT) AS signals, avg(stocks) AS stocks_per_day, avg(signal_mean) AS signal_mean, avg(baseline_mean) AS baseline_mean,
         avg(signal_up_rate) AS signal_up_rate, avg(baseline_up_rate) AS baseline_up_rate, avg(edge) AS edge, stddev_samp(edge) AS edge_daily_sd,
         avg(CAST(edge > 0 AS INT)) AS edge_positive_day_fraction, avg(rank_ic) AS rank_ic, stddev_samp(rank_ic) AS rank_ic_daily_sd, avg(signal_mean) - 0.003 AS signal_return_after_cost
  FROM daily GROUP BY factor, era)"""


def top_days(min_stocks: int = 50, top: int = 20, source: str = "in_era") -> str:
    return f"""
ranked AS (SELECT *, score > 0 AND row_number() OVER (PARTITION BY factor, era, day ORDER BY score DESC, vt_symbol) <= {top} AS selected FROM (
  {ranks('intent', f'(SELECT *, round(intent_return, 9) AS intent, round(worst_case_return, 9) AS worst FROM {source})')})),
daily AS (
  SELECT *, round(signal_mean - baseline_mean, 9) AS edge FROM (
    SELECT factor, era, day, count(*) AS stocks, count(*) FILTER (selected) AS signals, avg(intent) AS baseline_mean, avg(intent) FILTER (selected) AS signal_mean,
           median(intent) FILTER (selected) AS signal_median, avg(worst) FILTER (selected) AS signal_worst_case_mean, avg(CAST(intent > 0 AS INT)) FILTER (selected) AS signal_up_rate,
           avg(CAST(intent > 0 AS INT)) AS baseline_up_rate, count(*) FILTER (selected AND NOT entry_fill) AS entry_no_fills,
           count(*) FILTER (selected AND unclosed_at_horizon) AS unclosed, {CORR} AS rank_ic
    FROM ranked GROUP BY ALL)
  WHERE stocks >= {min_stocks} AND signals >= 1),
summary AS (
  SELECT *, signal_mean - 0.003 AS after_cost, edge - CASE WHEN days > 1 THEN 1.96 * edge_sd / sqrt(days) END AS edge_low,
         edge + CASE WHEN days > 1 THEN 1.96 * edge_sd / sqrt(days) END AS edge_high FROM (
    SELECT factor, era, count(*) AS days, CAST(sum(signals) AS BIGINT) AS signals, avg(stocks) AS stocks_per_day, avg(signal_mean) AS signal_mean, median(signal_median) AS signal_median_across_days,
           avg(signal_worst_case_mean) AS signal_worst_case_mean, avg(baseline_mean) AS baseline_mean, avg(edge) AS edge, stddev_samp(edge) AS edge_sd, median(edge) AS edge_median_across_days,
           avg(signal_up_rate) AS signal_up_rate, avg(baseline_up_rate) AS baseline_up_rate, avg(rank_ic) AS rank_ic, count(rank_ic) AS rank_ic_days,
           CAST(sum(entry_no_fills) AS BIGINT) AS entry_no_fills, CAST(sum(unclosed) AS BIGINT) AS unclosed_at_horizon
    FROM daily GROUP BY factor, era))"""


TOP_COLUMNS = "day, exit_day, vt_symbol, intent_return, worst_case_return, entry_fill, unclosed_at_horizon"
SIGNAL_COLUMNS = "day, exit_day, vt_symbol, forward_return"


def rounded(names: str, source: str, plain: str = "") -> str:
    keys = [p.strip() for p in plain.split(",") if p.strip()]
    return "SELECT " + ", ".join([*keys, *[f"round(CAST({n.strip()} AS DOUBLE), 6) AS {n.strip()}" for n in names.split(",")]]) + f" FROM {source}"
