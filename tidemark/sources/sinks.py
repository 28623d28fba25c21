"""Writers: keep-last upserts, slice replacement, guards. Partitions are rewritten whole, by a staged swap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import keep_last


class NonFiniteValues(ValueError):
    """A batch holds NaN or infinite numbers."""


def require_finite(df: DataFrame, columns: list[str], samples: int = 5) -> DataFrame:
    """The frame itself, or ``NonFiniteValues`` naming up to ``samples`` rows: a batch is taken or refused as a whole. Null is allowed."""
    bad = None
    for c in columns:
        test = F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
        bad = test if bad is None else bad | test
    rows = df.where(bad).limit(samples).collect() if bad is not None else []
    if rows:
        raise NonFiniteValues("; ".join(str(r.asDict()) for r in rows))
    return df


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _swap(df: DataFrame, staged: str, path: str, parts: list[str]) -> None:
    """Moves the staged partition folders over the old ones. An old one is renamed aside first and deleted when the new one is in its
    place; if that fails, it is renamed back. So at no time is a partition without its old or its new rows on disk."""
    spark = df.sparkSession
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(P(path))
    aside = f"{staged}_old"
    fs.mkdirs(P(aside))
    for part in parts:
        old, new, kept = P(f"{path}/{part}"), P(f"{staged}/{part}"), P(f"{aside}/{part}")
        had = fs.exists(old)
        if had and not fs.rename(old, kept):
            raise OSError(f"cannot move {part} aside")
        if fs.exists(new) and not fs.rename(new, old):
            if had:
                fs.rename(kept, old)
            raise OSError(f"cannot move {part}")
    fs.delete(P(aside), True)
    fs.delete(P(staged), True)


def upsert_partitioned(batch: DataFrame, path: str, keys: list[str], order: list[str], part: str) -> list[str]:
    """Merges a batch into a Parquet folder partitioned by ``part``; per key the row of greatest ``order`` stays.

    Only the partitions that the batch touches are read and rewritten. They are written beside the folder and swapped in at the
    end, so a job that fails leaves the old ones. A batch with a null in ``part`` is refused as a whole. Returns the partitions written. The list of touched partitions, one per
    distinct value of ``part`` in the batch, goes to the driver.
    """
    found = [r[0] for r in batch.select(part).distinct().collect()]
    if None in found:
        raise ValueError(f"rows without a {part}")
    values = sorted(found)
    if not values:
        return []
    merged = batch
    if _exists(batch, path):
        old = batch.sparkSession.read.schema(batch.schema).parquet(path).where(F.col(part).isin(values))
        merged = old.select(*batch.columns).unionByName(merged)
    merged = keep_last(merged, [*keys, part] if part not in keys else keys, order).select(*batch.columns)
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    # A partition's rows are spread by key, so that a large one is no single task.
    merged.repartition(part, *keys).sortWithinPartitions(part, *keys).write.partitionBy(part).parquet(staged)
    names = [f"{part}={v}" for v in values]
    _swap(batch, staged, path, names)
    return names


def upsert_by_year(bars: DataFrame, path: str) -> list[str]:
    """Bars into ``year=`` folders: refused as a whole if a price is not finite, the last delivery of each (symbol, date) stays."""
    require_finite(bars, ["open", "high", "low", "close"])
    return upsert_partitioned(bars.withColumn("year", F.year("date")), path, ["symbol", "date"], ["fetched_at"], "year")


def replace_slice(rows: DataFrame, path: str, part: str, value) -> None:
    """Replaces one partition by ``rows``, which must all belong to it; an empty slice removes it."""
    foreign = rows.where(~F.col(part).eqNullSafe(F.lit(value))).limit(1).collect()
    if foreign:
        raise ValueError(f"rows of another slice than {part}={value}: {foreign[0].asDict()}")
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    rows.write.partitionBy(part).parquet(staged)
    _swap(rows, staged, path, [f"{part}={value}"])


def coalesce_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Updates by key in which a null of the new row keeps what the old one knew. One row per key on either side."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__o"))
    n = new.select(*keys, F.struct(*rest).alias("__n"))
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(F.col(f"__n.`{c}`"), F.col(f"__o.`{c}`")).alias(c) for c in rest])


def delete_orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parent still exists."""
    return rows.join(parents.select(*keys).distinct(), keys, "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)
