"""The factor catalogue: for each study, score names and their expressions over the feature columns.

Scores are SQL expressions, so a study's scores are one projection and new ones need no code. Division by
zero gives NULL, which every kernel leaves out.
"""

from __future__ import annotations


def over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def gate(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0.0 END"


def pos(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ({x}) ELSE 0.0 END"


G, MG, LG, SG = "short_gap", "medium_gap", "long_gap", "slow_gap"
C5, C10, C20 = (f"(close / nullif(ma{n}, 0) - 1)" for n in (5, 10, 20))
R5, R10, R20 = (f"(close / nullif(close_lag{n}, 0) - 1)" for n in (5, 10, 20))
MA5_60, MA20_60 = "(ma5 / nullif(ma60, 0) - 1)", LG
VWR = over("weighted_sum10", "volume_sum10")
VR, EXTRA = "volume_ratio", "0.02 * (volume_ratio - 1)"
LOCATION = over("close - low20", "high20 - low20")
VOLATILITY = over("sd10", "sd40")

_plain = {
    "ma5_ma20": G, "ma10_ma40": MG, "ma5_ma60": MA5_60, "close_ma20": C20, "return_5": R5, "return_10": R10, "return_20": R20,
    "ma5_slope_3": "slope5_3", "ma20_slope_5": "slope20_5", "gap_change_5": "short_gap - (ma5_lag5 / nullif(ma20_lag5, 0) - 1)",
}

STOCK = (
    _plain
    | {"slope_difference": "slope5_3 - slope20_5", "volume_weighted_return_10": VWR}
    | {f"revert_{name}": f"-({x})" for name, x in _plain.items()}
    | {"revert_volume_weighted_return_10": f"-({VWR})", "pullback_in_uptrend": f"-{C20} + 0.25 * ({MA20_60})"}
    | {
        "volume_surprise": f"{VR} - 1", "volume_dryup": f"1 - {VR}", "volume_trend_5": f"{R5} * {VR}", "volume_reversal_5": f"-{R5} * {VR}",
        "trend_5_plus_volume": f"{R5} + {EXTRA}", "reversal_5_plus_volume": f"-{R5} + {EXTRA}", "ma_trend_plus_volume": f"{G} + {EXTRA}",
        "ma_revert_plus_volume": f"-{G} + {EXTRA}", "strong_trend_5": f"{over(R5, 'sd20')} - 1", "strong_reversal_5": f"{over('-' + R5, 'sd20')} - 1",
        "strong_ma_trend": f"{over(G, 'sd20')} - 1", "strong_ma_revert": f"{over('-' + G, 'sd20')} - 1",
        "breakout_high_20": "close / nullif(prev_high20, 0) - 1", "breakout_high_10": "close / nullif(prev_high10, 0) - 1",
        "breakdown_low_20": "prev_low20 / nullif(close, 0) - 1", "breakdown_low_10": "prev_low10 / nullif(close, 0) - 1",
        "near_high_20": "close / nullif(prev_high20, 0) - 0.98", "near_low_20": "1.02 - close / nullif(prev_low20, 0)",
        "upper_range_20": f"{LOCATION} - 0.5", "lower_range_20": f"0.5 - {LOCATION}", "volatility_contraction": f"1 - {VOLATILITY}",
        "volatility_expansion": f"{VOLATILITY} - 1", "quiet_ma_trend": f"{G} + 0.02 * (1 - {VOLATILITY})", "volatile_ma_revert": f"-{C20} + 0.02 * ({VOLATILITY} - 1)",
    }
)

_UP, _MUP = f"{G} > 0", f"{MG} > 0"
FOLLOWUP = {
    "ma_gap_control": G,
    **{f"fresh_cross5_{n}": gate(f"{_UP} AND crossed_short_{n} = 1", G) for n in (5, 10)},
    **{f"fresh_cross10_{n}": gate(f"{_MUP} AND crossed_medium_{n} = 1", MG) for n in (5, 10)},
    **{f"persistent5_{n}": gate(f"above_short_{n} = {n}", G) for n in (5, 10)},
    **{f"persistent10_{n}": gate(f"above_medium_{n} = {n}", MG) for n in (5, 10)},
    "aligned_short_long": gate(f"{_UP} AND {LG} > 0", G), "aligned_medium_long": gate(f"{_MUP} AND ma40 > ma60", MG),
    "both_slopes_up": gate(f"{_UP} AND slope5_3 > 0 AND slope20_5 > 0", G),
    "delta_3": "delta3", "delta_5": "delta5", "delta_10": "delta10", "medium_delta_5": "medium_delta5", "medium_delta_10": "medium_delta10",
    "gap_plus_delta": f"{G} + delta5", "gap_minus_delta": f"{G} - delta5", "slope_spread": "slope5_3 - slope20_5", "slow_slope_spread": "slope10_5 - slope40_10",
    "delta_acceleration": "delta5 - delta5_lag5", "widening_gap": gate(f"{_UP} AND delta5 > 0", G), "narrowing_gap": gate(f"{_UP} AND delta5 < 0", G),
    "long_control": LG, "long_below5": gate(f"{LG} > 0 AND close < ma5", LG), "long_below10": gate(f"{LG} > 0 AND close < ma10", LG),
    **{f"long_depth{n}": gate(f"{LG} > 0", f"-{c}") for n, c in ((5, C5), (10, C10), (20, C20))},
    **{f"long_minus_half{n}": f"{LG} - 0.5 * {c}" for n, c in ((5, C5), (10, C10), (20, C20))},
    "recovering_above_ma20": gate(f"{LG} > 0 AND close > ma20 AND close < ma5", LG), "long_up_short_down": gate(f"{LG} > 0 AND {G} < 0", LG),
    "aligned_dip": gate(f"{LG} > 0 AND {_UP} AND close < ma5", G),
    "broad_trend": gate("breadth_gap >= 0.5", G), "narrow_trend": gate("breadth_gap < 0.5", G), "broad_revert": gate("breadth_gap >= 0.5", f"-{G}"),
    "narrow_revert": gate("breadth_gap < 0.5", f"-{G}"), "broad_delta": gate("breadth_gap >= 0.5", "delta5"), "narrow_delta": gate("breadth_gap < 0.5", "delta5"),
    "gap_per_risk": over(G, "sd20"), "revert_per_risk": over(f"-{G}", "sd20"), "delta_per_risk": over("delta5", "sd20"),
    "revert_delta_per_risk": over("-delta5", "sd20"), "gap_less_risk": f"{G} - sd20", "revert_less_risk": f"-{G} - sd20",
}

_GATE = f"{LG} > 0 AND close > ma20 AND depth5 > 0"
_BELOW = f"{LG} > 0 AND close < ma20"
_D20 = "(ma20 / nullif(close, 0) - 1)"
_BASE = f"{LG} + depth5"


def _gated(more: str, value: str) -> str:
    return gate(f"{_GATE} AND {more}" if more else _GATE, value)


CLEAN = {
    "pullback_long": _gated("", LG), "pullback_depth": _gated("", "depth5"), "pullback_product": _gated("", f"{LG} * depth5"), "pullback_sum": _gated("", _BASE),
    "depth_005_030": _gated("depth5 BETWEEN 0.005 AND 0.03", LG), "depth_010_050": _gated("depth5 BETWEEN 0.01 AND 0.05", LG), "shallow": _gated("depth5 < 0.02", LG),
    "long_slope_up": _gated("slope20_5 > 0", LG), "up_day": _gated("day_return > 0", LG), "down_day": _gated("day_return < 0", LG),
    "below_ma10": _gated("close < ma10", LG), "short_slope_up": _gated("slope5_5 > 0", LG),
    **{f"breadth_over_{round(100 * b)}": _gated(f"breadth20 >= {b}", _BASE) for b in (0.45, 0.55, 0.65)},
    **{f"breadth_under_{round(100 * b)}": _gated(f"breadth20 < {b}", _BASE) for b in (0.45, 0.55)},
    "market_up_day": _gated("market_return > 0", _BASE), "market_down_day": _gated("market_return < 0", _BASE),
    "weaker_than_market": _gated("day_return < market_return", _BASE), "stronger_than_market": _gated("day_return > market_return", _BASE),
    "broad_strong_trend": _gated(f"breadth20 >= 0.55 AND {LG} > 0.02", _BASE), "broad_rising": _gated("breadth20 >= 0.55 AND slope20_5 > 0", _BASE),
    "narrow_up_day": _gated("breadth20 < 0.45 AND day_return > 0", _BASE),
    "below20_sum": gate(_BELOW, f"{LG} + {_D20}"), "below20_depth": gate(_BELOW, _D20), "below20_shallow": gate(f"{_BELOW} AND {_D20} < 0.02", f"{LG} + {_D20}"),
    "below20_mid": gate(f"{_BELOW} AND {_D20} BETWEEN 0.02 AND 0.06", f"{LG} + {_D20}"), "short_negative": gate(f"{LG} > 0 AND {G} < 0", f"{LG} - {G}"),
    "short_turned_negative": gate(f"{LG} > 0 AND {G} < 0 AND short_gap_lag1 >= 0", f"{LG} - {G}"),
    "short_turned_positive": gate(f"{LG} > 0 AND {G} > 0 AND short_gap_lag1 <= 0", f"{LG} + {G}"),
    "reclaim_ma20": gate(f"{LG} > 0 AND close > ma20 AND previous_close <= ma20_lag1", LG), "reclaim_ma5": gate(f"{LG} > 0 AND close > ma5 AND previous_close <= ma5_lag1", LG),
    "long_turned_positive": gate(f"{LG} > 0 AND long_gap_lag5 <= 0", LG), "long_turned_negative": gate(f"{LG} < 0 AND long_gap_lag5 >= 0 AND close > ma5", f"-{LG}"),
    "bear_short_negative": gate(f"{LG} < 0 AND {G} < 0 AND close > ma5", f"-{LG} - {G}"),
    "calm": _gated("sd20 < vol_median", _BASE), "restless": _gated("sd20 > vol_median", _BASE), "sd_under_025": _gated("sd20 < 0.025", _BASE),
    "sd_025_050": _gated("sd20 BETWEEN 0.025 AND 0.05", _BASE), "volume_over_120": _gated("volume_ratio > 1.2", _BASE), "volume_under_80": _gated("volume_ratio < 0.8", _BASE),
    "sum_per_risk": _gated("sd20 > 0", over(_BASE, "sd20")), "depth_per_risk": _gated("sd20 > 0", over("depth5", "sd20")),
    "depth_by_volume": _gated("volume_ratio > 0", f"{LG} + depth5 * volume_ratio"), "calm_weak": _gated("sd20 < vol_median AND day_return < market_return", _BASE),
    "calm_short_up": _gated("sd20 < vol_median AND slope5_5 > 0", _BASE), "calm_broad": _gated("sd20 < vol_median AND breadth20 >= 0.5", _BASE),
}

UNIFIED = {
    "ma20_over_60": pos(LG), "ma60_over_120": pos(SG), "ma5_over_20": pos(G), "price_over_ma20": pos(C20), "ma20_slope_5": pos("slope20_5"),
    "ma60_slope_10": pos("slope60_10"), "ma5_20_accel_5": pos("delta5"), "trend_persistence_20": gate(f"{LG} > 0 AND over_share20 > 0.5", "over_share20"),
    "uptrend_pullback": gate(_GATE, "depth5"), "uptrend_reclaim_ma5": gate(f"{LG} > 0 AND close > ma5 AND previous_close <= ma5_lag1", f"{LG} + {C5}"),
    "bear_trend_rebound": gate(f"{LG} < 0 AND close > ma5", f"-{LG} + {C5}"), "old_market_down_pullback": gate(f"{_GATE} AND market_return < 0", _BASE),
}

_ALIGNED, _TREND = f"{G} > 0 AND {LG} > 0 AND {SG} > 0", f"{LG} > 0 AND {SG} > 0"
_LOC = over("close - valid_low20", "valid_high20 - valid_low20")
_WIDENING = f"least({G} - short_gap_lag5, {LG} - long_gap_lag5, {SG} - slow_gap_lag5)"
_ATR = over("atr5", "atr20")
_BODY = over("close - open", "atr14")
_OPEN_GAP = "(open / nullif(previous_close, 0) - 1)"
_DROP = "1 - close / nullif(prev_valid_high20, 0)"
JOINT = gate(f"{_ALIGNED} AND short_gap_lag5 IS NOT NULL AND long_gap_lag5 IS NOT NULL AND slow_gap_lag5 IS NOT NULL", pos(_WIDENING))

PRICE_1 = {
    "ribbon_weakest_gap": pos(f"CASE WHEN {G} IS NOT NULL AND {LG} IS NOT NULL AND {SG} IS NOT NULL THEN least({G}, {LG}, {SG}) END"),
    "ribbon_joint_widening": JOINT,
    "ribbon_compress_expand": gate(f"{_ALIGNED} AND width_lag5 < width_lag10", pos("ribbon_width - width_lag5")),
    "trend_close_breakout20": gate(_TREND, pos("close / nullif(prev_valid_high20, 0) - 1")), "ribbon_range_high": gate(_ALIGNED, pos(f"{_LOC} - 0.8")),
    "trend_intraday_reclaim20": gate(f"{_TREND} AND low < ma20 AND close > ma20", pos(over("close - ma20", "atr14"))),
    "trend_peak_pullback_strong_close": gate(f"{_TREND} AND {_DROP} BETWEEN 0.02 AND 0.08", pos(f"{_LOC} - 0.7")),
    "ribbon_atr_contraction": gate(_ALIGNED, pos(f"(1 - {_ATR}) * ({pos(LG)})")),
    "ribbon_atr_expansion_green": gate(f"{_ALIGNED} AND close > open", pos(f"({pos(f'{_ATR} - 1')}) * ({over(pos('close - open'), 'atr14')})")),
    "trend_intraday_reclaim5": gate(f"{_TREND} AND open < ma5 AND close > ma5", pos(over(pos("close - open"), "atr14"))),
}

_NEAR, _INSIDE, _OUTSIDE = "close <= ma5 + 0.5 * atr14", "close <= prev_valid_high20", "close > prev_valid_high20"
_W, _RED = f"({JOINT})", "close < open"
_J, _U = f"({JOINT}) * ({pos(_OPEN_GAP)})", pos(_OPEN_GAP)
_GAP_ATR = over("open - previous_close", "atr14")
PRICE_2 = {
    "widening_near_ma5": gate(_NEAR, _W), "widening_strong_close": f"{_W} * ({pos(f'{_LOC} - 0.7')})", "widening_breakout": gate(_OUTSIDE, _W), "widening_inside": gate(_INSIDE, _W),
    "widening_green": f"{_W} * ({pos(_BODY)})", "widening_red": f"{_W} * ({pos(f'-({_BODY})')})", "widening_active": f"{_W} * ({pos(f'{VR} - 1')})",
    "widening_quiet": f"{_W} * ({pos(f'1 - {VR}')})", "widening_expanding": f"{_W} * ({pos(f'{_ATR} - 1')})", "widening_contracting": f"{_W} * ({pos(f'1 - {_ATR}')})",
    "widening_gap_up": f"{_W} * ({_U})", "widening_gap_down": f"{_W} * ({pos(f'-{_OPEN_GAP}')})",
}
PRICE_3 = {
    "gap_up_only": _U, "gap_up_aligned": gate(_ALIGNED, _U), "gap_up_widening": _J, "gap_up_aligned_only": gate(f"{_ALIGNED} AND {_W} <= 0", _U),
    "gap_widening_green": f"{_J} * ({pos(_BODY)})", "gap_widening_red": f"{_J} * ({pos(f'-({_BODY})')})", "gap_widening_active": f"{_J} * ({pos(f'{VR} - 1')})",
    "gap_widening_quiet": f"{_J} * ({pos(f'1 - {VR}')})", "gap_widening_breakout": gate(_OUTSIDE, _J), "gap_widening_inside": gate(_INSIDE, _J),
    "gap_small": gate(f"{_GAP_ATR} > 0 AND {_GAP_ATR} <= 0.5", _J), "gap_large": gate(f"{_GAP_ATR} > 0.5", _J),
}
_FAR, _LOW_CLOSE = "close > ma5 + 0.5 * atr14", over("close - low", "high - low")
PRICE_4 = {
    name: gate(condition, _J)
    for name, condition in {
        "every": "TRUE", "near": _NEAR, "far": _FAR, "red_near": f"{_RED} AND {_NEAR}", "red_far": f"{_RED} AND {_FAR}", "red_inside": f"{_RED} AND {_INSIDE}",
        "red_outside": f"{_RED} AND {_OUTSIDE}", "active_inside": f"{VR} > 1 AND {_INSIDE}", "active_outside": f"{VR} > 1 AND {_OUTSIDE}", "red_active": f"{_RED} AND {VR} > 1",
        "red_quiet": f"{_RED} AND {VR} <= 1", "close_lower_half": f"{_LOW_CLOSE} < 0.5", "close_upper_half": f"{_LOW_CLOSE} >= 0.5",
        "volume_normal": f"{VR} BETWEEN 0.8 AND 1.5", "volume_high": f"{VR} > 1.5",
    }.items()
}
PRICE = {name: pos(x) for batch in (PRICE_1, PRICE_2, PRICE_3, PRICE_4) for name, x in batch.items()}

SINGLE = {
    "gap_5_20": G, "gap_10_40": MG, "gap_5_60": MA5_60, "gap_change_3": "delta3", "gap_change_10": "delta10",
    "gap_acceleration_3": "short_gap - 2 * short_gap_lag3 + short_gap_lag6", "short_slope_3": "slope5_3", "long_slope_10": "slope20_10",
    "slope_difference_3": "slope5_3 - slope20_3", "above_share_10": "above_share10", "gap_per_risk": over(G, "sd20"), "gap_by_volume": over(f"{G} * volume", "volume_mean20"),
}

STUDIES = {"stock": STOCK, "followup": FOLLOWUP, "clean": CLEAN, "unified": UNIFIED, "price": PRICE, "single": SINGLE}
