"""Window functions over daily series: one row per (entity, day), all days at once.

Every function is causal unless its name says forward: the value of a row depends on rows up to it
only, so a reader may compute the whole history and filter by day afterwards. All windows are
partitioned by entity; chained calls reuse one hash partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(entity: str, day: str):
    return Window.partitionBy(entity).orderBy(day)


def sma(x: str, n: int, entity: str = "symbol", day: str = "date") -> Column:
    """Mean of the last ``n`` rows; null until there are ``n`` non-null ones."""
    w = by(entity, day).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def trailing_mean(x: str, n: int, entity: str = "symbol", day: str = "date") -> Column:
    """Mean of the non-null values of the last ``n`` rows; null for the first ``n - 1`` rows."""
    w = by(entity, day).rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(w) == n, F.avg(x).over(w))


def pct_change(x: str, lag: int = 1, entity: str = "symbol", day: str = "date") -> Column:
    """Change against the value ``lag`` rows back; null where that is missing or zero."""
    before = F.lag(x, lag).over(by(entity, day))
    return F.try_divide(F.col(x), before) - 1


def rolling_extreme(x: str, n: int, least: int, kind: str, entity: str = "symbol", day: str = "date") -> Column:
    """Minimum or maximum of the last ``n`` rows; null where fewer than ``least`` have a value."""
    w = by(entity, day).rowsBetween(1 - n, 0)
    f = F.max if kind == "max" else F.min
    return F.when(F.count(x).over(w) >= least, f(x).over(w))


def rising_streak(df: DataFrame, x: str, out: str, entity: str = "symbol", day: str = "date") -> DataFrame:
    """Rows in a row, up to this one, on which ``x`` rose strictly; null values take no part.

    A gaps-and-islands count: rows that did not rise start an island.
    """
    w = by(entity, day)
    rose = (F.col(x) > F.lag(x).over(w)).cast("int")
    part = df.where(F.col(x).isNotNull()).withColumn("__rose", F.coalesce(rose, F.lit(0)))
    part = part.withColumn("__island", F.sum(1 - F.col("__rose")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(entity, "__island").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn(out, F.sum("__rose").over(run)).drop("__rose", "__island")


def drawdown(x: str, entity: str = "symbol", day: str = "date") -> Column:
    """Fall below the running maximum, as a part of it."""
    top = F.max(x).over(by(entity, day).rowsBetween(Window.unboundedPreceding, 0))
    return (top - F.col(x)) / top


def suffix_max(x: str, entity: str = "symbol", day: str = "date") -> Column:
    """Maximum of this and all later rows. One descending sort, so each row costs the same."""
    down = Window.partitionBy(entity).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(x).over(down)


def episodes(df: DataFrame, level: str, out: str, entity: str = "symbol", day: str = "date") -> DataFrame:
    """Number of the run of equal levels that a row belongs to, from 1. Null equals null."""
    w = by(entity, day)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(level).eqNullSafe(F.lag(level).over(w))).cast("int"))
    df = df.withColumn("__new", new)
    return df.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def forward_return(x: str, h: int, entity: str = "symbol", day: str = "date") -> Column:
    """Change from this row to the row ``h`` rows on; null where the horizon is not complete."""
    return F.try_divide(F.lead(x, h).over(by(entity, day)), F.col(x)) - 1


def forward_worst(x: str, h: int, entity: str = "symbol", day: str = "date") -> Column:
    """Lowest of the next ``h`` rows against this one, at most 0; null where the horizon is not complete."""
    w = by(entity, day).rowsBetween(1, h)
    return F.when(F.count(x).over(w) == h, F.least(F.lit(0.0), F.min(x).over(w) / F.col(x) - 1))


def percentile_rank(df: DataFrame, x: str, within: list[str], out: str) -> DataFrame:
    """Rank of ``x`` within its group scaled to [0, 1], equal values sharing their mean rank; 0.5 for a group of one.

    Scale: the group's rows are first counted per distinct value (map-side combined), so repeated values do
    not meet in one task; the running count is over distinct values.
    """
    per_value = df.where(F.col(x).isNotNull()).groupBy(*within, x).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*within).orderBy(x)
    upto = F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__k").over(Window.partitionBy(*within))
    middle = upto - (F.col("__k") + 1) / 2
    rank = F.when(total == 1, 0.5).otherwise(middle / (total - 1))
    return df.join(per_value.select(*within, x, rank.alias(out)), [*within, x], "left")


def true_range(entity: str = "symbol", day: str = "date") -> Column:
    """Greatest of the row's range and its distances from the close before."""
    before = F.lag("close").over(by(entity, day))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
