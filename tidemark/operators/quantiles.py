"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group: ``group`` columns, ``n`` and the array ``quantiles`` in the order of ``probs``.

    Semantics
    - Null and NaN values don't count; a group without others gives no row. A null group column is a group of its own.
      Ties count as often as they occur. An empty table gives no rows.

    Method: values are counted. A coarse histogram (buckets of a monotone function of the value, some 500 a power of two) tells in
    which bucket the wanted ranks of each group lie; only the counted values of these buckets are then ranked.

    Scale: counts are combined map-side and spread over (group, value), so a group that holds all rows is no task of its own. A
    window runs over a group's histogram, of bounded size, or over the distinct values of one bucket.
    """
    g = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)]
    keys = [f"g{i}" for i in range(len(group))]
    v = F.col(f"`{value}`").cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).select(*g, v.alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("k"))
    size = F.least(F.abs("v"), F.lit(1e308))
    counts = counts.withColumn("bucket", F.floor(F.signum("v") * F.log2(1 + size) * 512))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in keys]
    coarse = counts.groupBy(*keys, "bucket").agg(F.sum("k").alias("k"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("k").over(whole.orderBy("bucket")) - F.col("k")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in probs])))
    hit = coarse.withColumns({"n": F.sum("k").over(whole), "below": upto})
    hit = hit.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("k")))).where(F.size("ranks") > 0)
    hit = hit.select(*[F.col(c).alias(f"t_{c}") for c in keys], F.col("bucket").alias("t_bucket"), "n", "below", "ranks")
    on = F.col("bucket") == F.col("t_bucket")
    for c in same:
        on = on & c
    inner = Window.partitionBy(*keys, "bucket").orderBy("v")
    near = counts.join(hit, on).withColumn("at", F.col("below") + F.sum("k").over(inner) - F.col("k"))
    near = near.withColumn("mine", F.filter("ranks", lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("k")))).where(F.size("mine") > 0)
    out = near.select(*keys, "n", F.explode("mine").alias("rank"), "v").groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))

    def quantile(p: float) -> F.Column:
        at = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col("m")[F.floor(at)], F.col("m")[F.ceil(at)]
        return lo + (hi - lo) * (at - F.floor(at))

    return out.select(*[F.col(c).alias(n) for c, n in zip(keys, group)], "n", F.array(*[quantile(p) for p in probs]).alias("quantiles"))
