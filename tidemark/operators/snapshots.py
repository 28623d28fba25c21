"""Differences between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Rows of a hash bucket: 40 bytes each.
BUCKET_ROWS = 500_000

COMPACT = "snap date, k1 long, k2 long, change string"


def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense int64 codes of 128-bit values given as two halves."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code


def _member(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 where it is not in."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def diff_bucket(table: pa.Table, days: np.ndarray) -> pa.Table:
    """Set differences of all consecutive snapshots within one hash bucket.

    ``table``: distinct (snap, k1, k2, r1, r2). A key with several row hashes in a
    snapshot counts with the set of them.
    """
    snap = table["snap"].to_numpy().astype("datetime64[D]").astype(np.int64)
    k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
    key = _pair_codes(k1, k2)
    row = _pair_codes(table["r1"].to_numpy(), table["r2"].to_numpy())
    order = np.lexsort((row, key, snap))
    snap, key, row, k1, k2 = snap[order], key[order], row[order], k1[order], k2[order]
    begin = np.searchsorted(snap, days, "left")
    end = np.searchsorted(snap, days, "right")
    out = {"snap": [], "at": [], "change": []}

    def emit(day: int, at: np.ndarray, change: str) -> None:
        out["snap"].append(np.full(len(at), day))
        out["at"].append(at)
        out["change"].append(np.full(len(at), change, object))

    for j in range(1, len(days)):
        p, q = slice(begin[j - 1], end[j - 1]), slice(begin[j], end[j])
        pk, pfirst, pcount = np.unique(key[p], return_index=True, return_counts=True)
        qk, qfirst, qcount = np.unique(key[q], return_index=True, return_counts=True)
        in_p, in_q = _member(pk, qk), _member(qk, pk)
        emit(days[j], q.start + qfirst[in_p < 0], "added")
        emit(days[j], p.start + pfirst[in_q < 0], "removed")
        both = np.flatnonzero(in_p >= 0)
        a, b = in_p[both], both
        same = (pcount[a] == qcount[b]) & (row[p.start + pfirst[a]] == row[q.start + qfirst[b]])
        many = np.flatnonzero(same & (qcount[b] > 1))
        for m in many:  # several spellings of one key within a snapshot: rare
            x = row[p.start + pfirst[a[m]] :][: pcount[a[m]]]
            y = row[q.start + qfirst[b[m]] :][: qcount[b[m]]]
            same[m] = np.array_equal(x, y)
        emit(days[j], q.start + qfirst[b[~same]], "changed")
    at = np.concatenate(out["at"]).astype(np.int64) if out["at"] else np.zeros(0, np.int64)
    snaps = np.concatenate(out["snap"]).astype("datetime64[D]") if out["snap"] else np.zeros(0, "datetime64[D]")
    change = np.concatenate(out["change"]) if out["change"] else np.zeros(0, object)
    return pa.table(
        {
            "snap": pa.array(snaps, pa.date32()),
            "k1": pa.array(k1[at], pa.int64()),
            "k2": pa.array(k2[at], pa.int64()),
            "change": pa.array(change, pa.string()),
        }
    )


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    keys: list[str],
    compared: dict[str, Column],
    values: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Records added, removed or changed between consecutive full snapshots.

    ``compared`` maps a name to the expression whose values are compared (so
    differences that do not count can be normalised away). Output: ``snapshot``
    (the later one), ``keys``, ``change`` (``added``, ``removed`` or ``changed``),
    and, for each of ``values``, ``old_<v>`` and ``new_<v>``.

    Semantics
    - Each snapshot is compared with the one before it among all snapshot dates of
      the table; the first has no changes.
    - Null differs from any value; null against null is no change. If a
      key comes several times in a snapshot, the sets of its distinct compared rows are compared;
      its old and new values are the greatest such row.
    - Rows whose snapshot date, or all of whose keys, are null belong to no snapshot. An empty
      table, or a single snapshot, gives no rows.

    Method: only 128-bit hashes of key and compared row travel: rows shrink to
    (snapshot, key hash, row hash), are made distinct map-side, and meet by hash
    bucket. Per bucket the arrays are sorted in numpy and consecutive snapshots are
    set against each other with ``searchsorted``. Full values are read
    back only for the keys that differ, by a join on (snapshot, key hash).

    Scale: a bucket holds about ``BUCKET_ROWS`` rows, as the number of buckets follows the number of rows; it
    does not depend on skew, since a repeated key is made distinct first. Buckets are streamed one at a time. The
    dates of the snapshots, a list as long as the calendar at most, go to the
    driver; nothing else does.
    """
    spark = df.sparkSession
    ship(spark)
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.select(F.col(f"`{snapshot}`")).count() // BUCKET_ROWS))
    key_cols = [F.col(f"`{k}`") for k in keys]
    rows = df.where(F.col(f"`{snapshot}`").isNotNull() & F.coalesce(*[k.cast("string") for k in key_cols]).isNotNull())
    # A null is hashed as its own value, so that it differs from any text.
    sig = lambda cols, seed: F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)])
    hashed = rows.select(
        F.col(f"`{snapshot}`").cast("date").alias("snap"),
        sig(key_cols, 1).alias("k1"),
        sig(key_cols, 2).alias("k2"),
        sig(list(compared.values()), 3).alias("r1"),
        sig(list(compared.values()), 4).alias("r2"),
    )
    days = np.array(
        sorted(r[0] for r in rows.select(F.col(f"`{snapshot}`").cast("date")).distinct().collect()),
        dtype="datetime64[D]",
    ).astype(np.int64)
    compact = hashed.distinct().withColumn("bucket", F.pmod("k1", F.lit(buckets)))

    def per_bucket(table: pa.Table) -> pa.Table:
        return diff_bucket(table, days)

    diff = compact.groupBy("bucket").applyInArrow(per_bucket, COMPACT)
    # Each difference names the snapshot in which its key's values stand.
    at = np.r_[days[:1], days[:-1]] if len(days) else days
    before = F.create_map(*[F.lit(x) for d, b in zip(days[1:], at[1:]) for x in (int(d), int(b))]) if len(days) > 1 else None
    day_no = F.unix_date("snap")
    old_day = (before[day_no] if before is not None else F.lit(None).cast("int"))
    sides = diff.withColumn(
        "side",
        F.explode(
            F.when(F.col("change") == "added", F.array(day_no))
            .when(F.col("change") == "removed", F.array(old_day))
            .otherwise(F.array(old_day, day_no))
        ),
    )
    values = values or []
    full = rows.select(
        F.unix_date(F.col(f"`{snapshot}`").cast("date")).alias("side"),
        sig(key_cols, 1).alias("k1"),
        sig(key_cols, 2).alias("k2"),
        F.struct(*key_cols).alias("__keys"),
        F.struct(*[F.col(f"`{v}`") for v in values]).alias("__values") if values else F.lit(1).alias("__values"),
    )
    met = sides.join(full, ["side", "k1", "k2"])
    is_new = (F.col("side") == day_no).alias("is_new")
    aggs = [F.max("__keys").alias("__keys")]
    if values:
        aggs += [
            F.max(F.when(F.col("is_new"), F.col("__values"))).alias("__new"),
            F.max(F.when(~F.col("is_new"), F.col("__values"))).alias("__old"),
        ]
    met = met.select("snap", "k1", "k2", "change", is_new, "__keys", "__values")
    out = met.groupBy("snap", "k1", "k2", "change").agg(*aggs)
    return out.select(
        F.col("snap").alias(snapshot),
        *[F.col(f"__keys.`{k}`").alias(k) for k in keys],
        "change",
        *[F.col(f"__old.`{v}`").alias(f"old_{v}") for v in values],
        *[F.col(f"__new.`{v}`").alias(f"new_{v}") for v in values],
    )
