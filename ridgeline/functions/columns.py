"""Column functions shared by all studies. Everything is a built-in expression; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL, DAY = "vt_symbol", "day"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def finite(x: Column | str) -> Column:
    """True for numbers, false for NaN and infinities, NULL for NULL."""
    return ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf")))


def finite_or_null(x: Column | str) -> Column:
    return F.when(finite(x), col(x))


def positive(x: Column) -> Column:
    """x where it is above 0, else 0; NULL gives 0."""
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def gated(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))


def valid_price(x: Column | str) -> Column:
    """x as a double if it is a finite number in (0, 1e100), else NULL."""
    p = F.try_cast(col(x), "double") if hasattr(F, "try_cast") else col(x).try_cast("double")
    return F.when(finite(p) & (p > 0) & (p < 1e100), p)


def on_grid(price: Column, tick: Column) -> Column:
    steps = F.try_divide(price, tick)
    return F.abs(steps - F.rint(steps)) < 1e-6


def rows_of(symbol: str = SYMBOL, day: str = DAY):
    return Window.partitionBy(symbol).orderBy(day)


def rolling(how, x: Column | str, n: int, ending: int = 0, window=None) -> Column:
    """how(x) over n rows up to the one `ending` rows back; NULL unless all n values are there and not NULL."""
    frame = (rows_of() if window is None else window).rowsBetween(-(n - 1) - ending, -ending)
    return F.when(F.count(col(x)).over(frame) == n, how(col(x)).over(frame))


def lag(x: Column | str, n: int, window=None) -> Column:
    """The value n rows of the symbol earlier, NULL values included."""
    return F.lag(col(x), n).over(rows_of() if window is None else window)


def ahead_max(x: Column | str, n: int, window=None) -> Column:
    """The largest value in the next n rows, 0 if there is none."""
    return F.coalesce(F.max(col(x)).over((rows_of() if window is None else window).rowsBetween(1, n)), F.lit(0))


def average_rank(x: Column | str, *groups: str) -> Column:
    """Rank from 1 within groups, equal values sharing the mean of their places."""
    ordered = Window.partitionBy(*groups).orderBy(col(x))
    ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)  # in the same order: one sort serves both
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def ordered_ranks(rows: DataFrame, x: str, groups: list[str], unique: str, place: str, rank: str) -> DataFrame:
    """rows with `place`, from 1 for the largest x, equal ones in order of `unique`, and `rank`, less than 0, which rises with x and is shared by equal ones.

    The places are made first: their order begins with that of the ranks, which then need no sort of their own.
    """
    falling = Window.partitionBy(*groups).orderBy(F.col(x).desc())
    ties = falling.rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(x).desc(), unique)))
    return rows.withColumn(rank, -(F.rank().over(falling) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)))


def melted(rows: DataFrame, keep: list[str], columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """keep, name and value: a row for each of the named columns. Rows stay where they are, so a partitioning holds."""
    each = F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in columns.items()])
    return rows.select(*keep, F.inline(each))


def place(*groups: str, order: list) -> Column:
    """Place from 1 within groups; order has to end with a unique key."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation as an aggregate; NULL where a side is constant."""
    return F.try_divide(F.covar_samp(col(a), col(b)), F.stddev_samp(col(a)) * F.stddev_samp(col(b)))


def mean_where(x: Column | str, condition: Column) -> Column:
    return F.avg(F.when(condition, col(x)))


def rate(condition: Column, among: Column | None = None) -> Column:
    """The share of rows with the condition, among those that have one and meet `among`."""
    flag = condition.cast("double")
    return F.avg(flag if among is None else F.when(among, flag))
