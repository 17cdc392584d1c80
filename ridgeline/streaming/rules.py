"""The trading rules as column expressions: each gives the first reason against, in a fixed order, or ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import on_grid, valid_price

#: Daily sessions in seconds of the day, fixed by the exchange.
SESSIONS = ((32400, 36900), (37800, 41400), (48600, 54000))
NIGHT = (75600, 95400)


def first_reason(checks: list[tuple[str, Column]], missing: str) -> Column:
    """The name of the first check that is true, '' if none is; a check that is NULL stops there with `missing`."""
    chain = F.lit("")
    for name, wrong in reversed(checks):
        chain = F.when(wrong.isNull(), F.lit(missing)).when(wrong, F.lit(name)).otherwise(chain)
    return chain


def seconds_to_break(now: Column) -> Column:
    """Seconds to the end of the session that a local timestamp falls in, 0 outside of sessions.

    The night session of a working day runs to 02:30 of the next one.
    """
    second = F.hour(now) * 3600 + F.minute(now) * 60 + F.extract(F.lit("SECOND"), now).cast("double")
    working, after = F.weekday(F.to_date(now)) < 5, F.weekday(F.date_sub(F.to_date(now), 1)) < 5
    spans = [(working, *s) for s in SESSIONS] + [(working, *NIGHT), (after, 0, NIGHT[1] - 86400)]
    chain = F.lit(0.0)
    for open_day, start, end in reversed(spans):
        chain = F.when(open_day & (second >= start) & (second < end), F.lit(float(end)) - second).otherwise(chain)
    return chain


def quote_reason(opening: bool = True) -> Column:
    """Against a quote row (received_age, trading_day, day, exchange_lag, last, bid, ask, lower, upper, bid_volume, ask_volume, step)."""
    c = F.col
    prices = ["last", "bid", *(["ask"] if opening else [])]
    invalid = reduce(lambda a, b: a | b, [valid_price(p).isNull() for p in [*prices, "lower", "upper"]])
    off = reduce(lambda a, b: a | b, [~c(p).between(c("lower"), c("upper")) | ~on_grid(c(p), c("step")) for p in prices])
    checks = [
        ("invalid_tick_size", valid_price("step").isNull()), ("receive_stale", ~c("received_age").between(0, 2)), ("wrong_trading_day", c("trading_day") != c("day")),
        ("exchange_stale_or_future", ~c("exchange_lag").between(-0.5, 2)), ("invalid_price", invalid), ("invalid_limits", c("lower") >= c("upper")),
        ("empty_book", (c("bid_volume") < 1) | (c("ask_volume") < 1) if opening else c("bid_volume") < 1), ("price_outside_limits_or_tick", off),
    ]
    if opening:
        nearest = F.least(c("last") - c("lower"), c("upper") - c("last"), c("bid") - c("lower"), c("upper") - c("ask"))
        checks += [("crossed_book", c("bid") > c("ask")), ("spread_too_wide", c("ask") - c("bid") > 5 * c("step") + 1e-8), ("near_price_limit", nearest < 2 * c("step") - 1e-8)]
    return first_reason(checks, "incomplete_quote")


def costs() -> dict[str, Column]:
    c = F.col
    value = c("upper") * c("multiplier")
    return {
        "estimated_margin": value * c("margin_by_money") + c("margin_by_volume"),
        "fee_reserve": value * (c("open_by_money") + c("close_by_money")) + c("open_by_volume") + c("close_by_volume"),
    }


def entry_reason() -> Column:
    """Against an entry: contract, account, position, orders and costs, in this order."""
    c = F.col
    required = 1.2 * c("estimated_margin") + 2 * c("fee_reserve") + c("max_loss")
    checks = [
        ("unsupported_contract", (c("exchange") != "SHFE") | ~c("product").isin("au", "ag") | (c("product_class") != "1") | ~c("tradable")),
        ("invalid_contract", valid_price("step").isNull() | valid_price("multiplier").isNull()), ("existing_position_or_frozen", c("open_positions") > 0),
        ("existing_working_order", c("working_orders") > 0), ("wrong_currency", c("currency") != "CNY"),
        ("invalid_funds", (c("balance") <= 0) | (c("available") <= 0) | (c("max_loss") <= 0)), ("incomplete_risk_data", c("estimated_margin") <= 0),
        ("margin_exceeds_10_percent_equity", c("estimated_margin") > 0.1 * c("balance")), ("insufficient_available", c("available") < required),
        ("loss_budget_below_cost_buffer", c("max_loss") < c("fee_reserve") + 2 * c("step") * c("multiplier")),
    ]
    return first_reason(checks, "incomplete_risk_data")


def ready_reason() -> Column:
    """Against trading at all: connection, review, status, session, quote, plan and query state, then the entry rules."""
    c = F.col
    checks = [
        ("connection_or_settlement_not_ready", ~(c("connected") & c("settled"))), ("manual_review_required", c("frozen")), ("not_continuous_trading", c("status") != "2"),
        ("less_than_120_seconds_to_break", c("seconds_left") < 120), ("missing_contract", ~c("has_contract")), ("missing_quote", ~c("has_quote")),
    ]
    later = [
        ("threshold_outside_limits_or_tick", ~c("threshold").between(c("lower"), c("upper")) | ~on_grid(c("threshold"), c("step"))), ("expired_contract", c("expires") < c("day")),
        ("approved_parameters_expired", c("deadline") < c("now")), ("preflight_queries_incomplete", ~c("preflight")), ("account_snapshot_stale", c("snapshot_age") > 20),
    ]
    early, late = first_reason(checks, "manual_review_required"), first_reason(later, "risk_rates_or_funds_missing")
    quote, entry = quote_reason(), entry_reason()
    return F.when(early != "", early).when(quote != "", quote).when(late != "", late).otherwise(entry)


def exit_reason() -> Column:
    """Why an open position is closed: a stop on the bid first, then time held, a user's stop, the end of the session."""
    c = F.col
    return (
        F.when(c("bid") <= c("stop_price"), "stop_loss").when(c("held_seconds") >= 60, "time_limit").when(c("stop_requested"), "user_stop").when(c("seconds_left") < 30, "session_ending").otherwise("")
    )


def quotes(rows: DataFrame) -> DataFrame:
    """Ticks as full quotes whose fields go wrong now and then, to exercise every reason."""
    k = F.col("detail")
    price = F.round(F.col("price"), 1)
    return rows.select(
        "symbol", "seq", "ts", F.when(k % 23 == 0, 0.0).otherwise(0.1).alias("step"), F.when(k % 19 == 0, 2.5).otherwise(F.lit(1.0)).alias("received_age"),
        F.when(k % 17 == 0, "x").otherwise("d").alias("trading_day"), F.lit("d").alias("day"), F.when(k % 13 == 0, -0.75).otherwise(0.25).alias("exchange_lag"),
        F.when(k % 29 != 0, price).alias("last"), F.round(price - 0.1, 1).alias("bid"),
        F.round(F.when(k % 7 == 0, price - 0.2).when(k % 11 == 0, price + 0.9).otherwise(price + 0.1), 1).alias("ask"),
        F.round(price - F.when(k % 31 == 0, 0.1).otherwise(5), 1).alias("lower"), F.round(price + F.when(k % 37 == 0, -9).otherwise(5), 1).alias("upper"),
        F.when(k % 41 != 0, (k % 5).cast("int")).alias("bid_volume"), F.lit(3).alias("ask_volume"),
    )
