"""Checks of a table in the pass that makes it: counts of what is wrong, observed while the result is written.

A check is a count of wrong rows. `publish` writes the rows and names the version only if every count is zero, so the checks cost no job;
`verify` counts them in one job and gives the rows back as a plan. Both raise ValueError with the counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ridgeline.sources import files


@dataclass
class Checked:
    """Rows with flags, the counts of wrong ones by message, and which rows and columns are the result."""

    frame: DataFrame
    wrong: dict[str, Column]
    kept: Column
    columns: list[str]

    def _counts(self) -> list[Column]:
        return [count.cast("long").alias(f"c{k}") for k, count in enumerate(self.wrong.values())]

    def _raise(self, found: dict) -> None:
        bad = {message: found[f"c{k}"] for k, message in enumerate(self.wrong) if found[f"c{k}"]}
        if bad:
            raise ValueError("; ".join(f"{message}: {count}" for message, count in bad.items()))

    def rows(self, frame: DataFrame | None = None) -> DataFrame:
        return (self.frame if frame is None else frame).where(self.kept).select(*self.columns)

    def verify(self) -> DataFrame:
        self._raise(self.frame.agg(*self._counts()).first().asDict())
        return self.rows()

    def publish(self, path: str, partitions: int | None = None) -> str:
        seen = Observation()
        return files.publish(self.rows(self.frame.observe(seen, *self._counts())), path, partitions, before_naming=lambda: self._raise(seen.get))


def _one_for_one(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__of_{c}"]) for c in on])


def attached(rows: DataFrame, facts: DataFrame, on: list[str]) -> Checked:
    """rows with the columns of facts, one fact for each row; a missing key is a key of its own.

    Facts are gathered by key on the way to the join, which deals them by the same key: repeats show as their number.
    """
    more = [c for c in facts.columns if c not in on]
    held = facts.groupBy(*[F.col(c).alias(f"__of_{c}") for c in on]).agg(F.count("*").alias("__facts"), *[F.first(c).alias(c) for c in more])
    flagged = rows.withColumn("__row", F.lit(True))
    joined = flagged.join(held, _one_for_one(flagged, held, on), "full")
    wrong = {f"rows without a fact by {on}": F.count_if(F.col("__row") & F.col("__facts").isNull()), f"facts repeat {on}": F.count_if(F.col("__facts") > 1)}
    return Checked(joined, wrong, F.col("__row").isNotNull(), [*rows.columns, *more])


def members(rows: DataFrame, least: int, most: int) -> Checked:
    """Snapshot members (day, vt_symbol): none twice, no day with fewer or more of them than a snapshot can have, some at all."""
    day, one = Window.partitionBy("day"), Window.partitionBy("day", "vt_symbol")
    counted = rows.withColumns({"__n": F.count("*").over(day), "__same": F.count("*").over(one)})
    wrong = {
        "members that are there more than once": F.count_if(F.col("__same") > 1), f"members of days with fewer than {least} of them": F.count_if(F.col("__n") < least),
        f"members of days with more than {most} of them": F.count_if(F.col("__n") > most), "no members": F.when(F.count("*") == 0, 1).otherwise(0),
    }
    return Checked(counted, wrong, F.lit(True), rows.columns)


def calendar(bars: DataFrame, days: DataFrame) -> Checked:
    """Bars on market days of the calendar alone, and on each of them between their first and last: the bars' days, one row each.

    The windows run over days.
    """
    held = bars.select("day").distinct().withColumn("__bar", F.lit(True))
    wanted = days.select(F.col("day").alias("__of_day")).distinct()
    joined = held.join(wanted, F.col("day") == F.col("__of_day"), "full")
    all_days = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = joined.withColumns({"__first": F.min("day").over(all_days), "__last": F.max("day").over(all_days)})
    missing = F.col("__bar").isNull() & F.col("__of_day").between(F.col("__first"), F.col("__last"))
    wrong = {"days are not in the calendar": F.count_if(F.col("__bar") & F.col("__of_day").isNull()), "days of the calendar have no bar": F.count_if(missing)}
    return Checked(joined, wrong, F.col("__bar").isNotNull(), ["day"])
