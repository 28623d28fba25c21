"""Totals and averages over trailing calendar periods by block decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_days(daily: DataFrame, entity: str, day: str, values: list[str]) -> DataFrame:
    """Every calendar day of an entity from its first to its last row; days
    without a row have null values. ``daily`` holds one row per (entity, day).

    The gap to the next row is laid out by the row itself, so no calendar table
    is joined: one sort per entity, then an explode of the gap.
    """
    w = Window.partitionBy(entity).orderBy(day)
    gap = F.coalesce(F.lead(day).over(w), F.date_add(day, 1))
    laid = daily.withColumn("__gap", F.datediff(gap, F.col(day))).withColumn(
        "__k", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1))
    )
    first = F.col("__k") == 0
    return laid.select(
        entity,
        F.expr(f"date_add(`{day}`, __k)").alias(day),
        first.alias("has_row"),
        *[F.when(first, F.col(v)).alias(v) for v in values],
    )


def trailing_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    values: list[str],
    lengths: list[int],
) -> DataFrame:
    """Trailing totals and counts per entity and calendar day.

    Input: one row per (entity, day); ``day`` is a date. Output: one row per
    entity and calendar day from its first to its last row, with
    ``<value>_sum_<n>`` and ``<value>_cnt_<n>`` for every value and length
    ``n``: the total and the number of non-null values over the ``n`` calendar
    days that end on ``day``; ``age`` is the number of days since the entity's first.

    Method: the days are cut into blocks of ``n`` days (by the day's number, the
    same for all entities). Inside a block, ``prefix`` is the total from the
    block's start to a day and ``suffix`` that from a day to the block's end.
    A period that ends at position ``p`` of its block is the suffix that begins
    ``n - 1`` days earlier, in the block before, plus the prefix at ``p``; at the
    block's last position it is the prefix alone. No total is made by taking one
    cumulative sum from another, so a NaN or infinite value touches only
    the periods that hold it, and a double never loses digits to a large past.

    Semantics
    - Null values and days without a row add 0 to the total and to the count;
      the average over the values present is sum / count, null if the count is 0.
    - Sums of longs that overflow are null (``try_sum``).
    - Rows with a null entity or day are ignored. An empty table gives no rows.

    Scale: everything runs on one hash partitioning by entity (one shuffle, the
    three window sorts reuse it). An entity's rows are bounded by the days of
    the calendar, however often its bars were delivered, since ``daily`` is
    already one row per day.
    """
    daily = daily.select(entity, day, *values).where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    dense = calendar_days(daily, entity, day, values).withColumn("__n", F.unix_date(day))
    out = dense
    for n in lengths:
        block = F.floor(F.col("__n") / n)
        up = Window.partitionBy(entity, "__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(entity, "__block").orderBy("__n").rowsBetween(0, Window.unboundedFollowing)
        cols = {}
        for v in values:
            add = F.try_sum if dict(dense.dtypes)[v] in ("bigint", "int", "smallint", "tinyint") else F.sum
            cols[f"__p_{v}_{n}"] = F.struct(add(v).over(up).alias("s"), F.count(v).over(up).alias("c"))
            cols[f"__s_{v}_{n}"] = F.struct(add(v).over(down).alias("s"), F.count(v).over(down).alias("c"))
        out = out.withColumn("__block", block).withColumns(cols)
    back = Window.partitionBy(entity).orderBy("__n")
    all_before = back.rowsBetween(Window.unboundedPreceding, 0)
    reach = {"__first": F.first("__n").over(all_before)}
    for n in lengths:
        for v in values:
            s = f"__s_{v}_{n}"
            reach[f"__b_{v}_{n}"] = F.coalesce(F.lag(s, n - 1).over(back), F.first(s).over(all_before))
    out = out.withColumns(reach)
    final = {}
    for n in lengths:
        # The first day that counts; at the entity's beginning the period is cut short.
        start = F.greatest(F.col("__n") - (n - 1), F.col("__first"))
        one_block = F.floor(start / n) == F.floor(F.col("__n") / n)
        for v in values:
            p, b = f"__p_{v}_{n}", f"__b_{v}_{n}"
            zero = F.lit(0).cast(dict(dense.dtypes)[v])
            have = lambda x: F.when(F.col(f"{x}.c") > 0, F.col(f"{x}.s")).otherwise(zero)
            final[f"{v}_sum_{n}"] = F.when(one_block, have(p)).otherwise(F.try_add(have(p), have(b)))
            final[f"{v}_cnt_{n}"] = F.when(one_block, F.col(f"{p}.c")).otherwise(F.col(f"{p}.c") + F.col(f"{b}.c"))
    age = (F.col("__n") - F.col("__first")).alias("age")
    return out.withColumns(final).select(entity, day, age, "has_row", *values, *final)
