"""Published screens of the studies, and the selection of one factor from them.

A rule names, for each era, the least value of each summary column and whether the value itself is enough. A factor
qualifies if it meets every era's rule. Where none does, a selection falls back to wider pools in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.evaluate import COST

Rule = dict[str, tuple[float, bool]]


def rule(days: int, signals: int, mean: float, edge: float | None = None, ic: float | None = None, ic_days: int | None = None, **more) -> Rule:
    """Counts are met by their least value, figures have to be above theirs."""
    out: Rule = {"days": (days, True), "signals": (signals, True), "signal_mean": (mean, False)}
    out |= {"edge": (edge, False)} if edge is not None else {}
    out |= {"rank_ic": (ic, False)} if ic is not None else {}
    out |= {"rank_ic_days": (ic_days, True)} if ic_days is not None else {}
    return out | {name: (least, False) for name, least in more.items()}


# The thresholds of the published studies.
SCREENS: dict[str, dict[str, Rule]] = {
    "stock": {era: rule(50, 500, 0, edge=0, ic=0) for era in ("train", "valid")},
    "followup": {era: rule(60, 500, COST, edge=0.0015, ic=0.01) for era in ("train", "valid")},
    "clean": {era: rule(days, 500, COST, edge=0.0015, ic=0.01, ic_days=days // 2) for era, days in (("train", 60), ("valid", 60), ("old_dev", 30), ("new_dev", 30))},
    "clean_ideal": {"holdout": rule(20, 250, COST, ic=0.01, edge_low=0)},
    "unified": {era: rule(40, 400, COST, edge=0.0015, ic=0.01) for era in ("train", "valid", "old_dev", "new_dev")},
    "price": {era: rule(20, 200, COST) for era in ("train", "valid", "test")},
    "transfer": {
        "first": rule(50, 500, COST), "second": rule(50, 500, COST), "third": rule(50, 500, float("-inf")), "combined": rule(50, 500, float("-inf"), edge=0, net_low=0),
    },
}

#: The studies that are screened over four development eras and a holdout.
FIVE_ERAS = [
    ("train", "1995-01-02", "1996-12-31"), ("valid", "1997-01-01", "1998-12-31"), ("old_dev", "1999-01-01", "1999-12-31"),
    ("new_dev", "2000-01-01", "2000-12-31"), ("holdout", "2001-01-01", "2001-11-05"),
]


def _meets(wanted: Rule) -> Column:
    ok = F.lit(True)
    for column, (least, equal) in wanted.items():
        ok &= F.coalesce(F.col(column) >= least if equal else F.col(column) > least, F.lit(False))
    return ok


def meets(rules: dict[str, Rule]) -> Column:
    """Whether an era's row meets its rule."""
    met = F.lit(False)
    for era, wanted in rules.items():
        met = F.when(F.col("era") == era, _meets(wanted)).otherwise(met)
    return met


def screened(summary: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One row per factor with the columns of its weakest era and `qualifies`: every era of the rules is there and meets its own."""
    judged = summary.where(F.col("era").isin(*rules)).withColumn("met", meets(rules))
    out = judged.groupBy("factor").agg(
        F.count_if("met").alias("eras_met"), F.min("edge").alias("weakest_edge"), F.min("signal_mean").alias("weakest_signal_mean"), F.min("signals").alias("fewest_signals"),
    )
    return out.withColumn("qualifies", F.col("eras_met") == len(rules))


def selected(summary: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """The one factor that the keep-all study locks: (factor, pool, pool_size, weakest_after_cost, weakest_edge); no row if no pool has any.

    Pool 1 are factors that qualify; pool 2 those with at least 20 days, 300 signals, a gain after cost and an edge in
    each era; pool 3 those with so many days and signals. The first pool that is not empty counts. Of pools 1 and 2 the
    largest weakest gain after cost wins, then the largest weakest edge; of pool 3 the other way round; then the last name.
    """
    return selected_of_each(summary.withColumn("__all", F.lit(1)), rules, "__all").drop("__all")


def selected_of_each(summary: DataFrame, rules: dict[str, Rule], key: str) -> DataFrame:
    """As selected, for each value of a key: one row with the key, of those that have any pool."""
    covered = rule(20, 300, float("-inf"))
    figures = summary.where(F.col("era").isin(*rules)).withColumn("gain", F.col("signal_mean") - COST)
    whole = lambda met: F.count_if(met) == len(rules)
    factors = figures.groupBy(key, "factor").agg(
        F.when(whole(meets(rules)), 1).when(whole(_meets(covered | rule(20, 300, COST, edge=0))), 2).when(whole(_meets(covered)), 3).alias("pool"),
        F.min("gain").alias("weakest_after_cost"), F.min("edge").alias("weakest_edge"),
    )
    factors = factors.where("pool IS NOT NULL")
    first, second = (F.when(F.col("pool") < 3, F.col(a)).otherwise(F.col(b)) for a, b in (("weakest_after_cost", "weakest_edge"), ("weakest_edge", "weakest_after_cost")))
    # The windows run over the factors of a study, a row each.
    best = Window.partitionBy(key).orderBy("pool", first.desc(), second.desc(), F.desc("factor"))
    ranked = factors.withColumns({"pool_size": F.count("*").over(Window.partitionBy(key, "pool")), "__place": F.row_number().over(best)})
    return ranked.where("__place = 1").select(key, "factor", "pool", "pool_size", "weakest_after_cost", "weakest_edge")


def selected_by_validation(summary: DataFrame, rules: dict[str, Rule], fallback: bool = True) -> DataFrame:
    """The factor that the first study and its follow-up retain: (factor, pool, edge), edge being that of validation, the largest of its pool.

    Pool 1 are factors that qualify; with fallback, pool 2 those with 60 days in training and validation and an edge in
    training, pool 3 those with 60 days in validation.
    """
    era = lambda name, c: F.max(F.when(F.col("era") == name, F.col(c)))
    days = F.coalesce(era("train", "days"), F.lit(0)), F.coalesce(era("valid", "days"), F.lit(0))
    pool = F.when(F.count_if(meets(rules)) == len(rules), 1)
    if fallback:
        pool = pool.when((days[0] >= 60) & (days[1] >= 60) & F.coalesce(era("train", "edge") > 0, F.lit(False)), 2).when(days[1] >= 60, 3)
    out = summary.groupBy("factor").agg(pool.alias("pool"), era("valid", "edge").alias("edge")).where("pool IS NOT NULL")
    return out.orderBy("pool", F.col("edge").desc_nulls_last(), "factor").limit(1)
