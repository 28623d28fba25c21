"""Deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Shares of ``total`` by stratum size: floors, then one more each for the largest remainders, ties by name.

    One row per stratum reaches the single-partition window, never the rows themselves.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    s = sizes.withColumn("__all", F.sum("size").over(Window.partitionBy(F.lit(1))))
    whole = F.floor(F.lit(total) * F.col("size") / F.col("__all"))
    # The remainder as an integer numerator, so that equal remainders tie exactly.
    rest = F.pmod(F.lit(total) * F.col("size"), F.col("__all"))
    s = s.withColumn("quota", whole).withColumn("__rest", rest)
    one = Window.partitionBy(F.lit(1))
    left = F.lit(total) - F.sum("quota").over(one)
    place = F.row_number().over(one.orderBy(F.desc("__rest"), F.col(stratum).asc_nulls_first()))
    return s.withColumn("__left", left).withColumn("__place", place).select(
        stratum, "size", F.least(F.col("size"), F.col("quota") + (F.col("__place") <= F.col("__left")).cast("long")).alias("quota")
    )


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, salt: str) -> DataFrame:
    """About ``total`` rows with the strata's shares; within a stratum the rows of least SHA-256 of salt and key.

    ``df`` has one row per key. The order is a hash of the key, so the sample does not depend on partitioning and a
    larger total keeps what a smaller one took.
    """
    q = quotas(df, stratum, total)
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), F.col(key))
    ranked = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= total)
    on = F.col("d." + stratum).eqNullSafe(F.col("q." + stratum))
    return ranked.alias("d").join(q.alias("q"), on).where("__n <= q.quota").select("d.*").drop("__n")
