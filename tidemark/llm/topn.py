"""The N highest-scoring items of every group by simultaneous bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship

#: Rows that are gathered from Arrow batches before one bisection; bounds a task's memory.
ROWS_AT_ONCE = 200_000


def score_code(x: np.ndarray) -> np.ndarray:
    """Order-preserving int64 of finite doubles; -0.0 counts as 0.0."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    u, inv = np.unique(values, return_inverse=True)
    return inv.astype(np.int64), len(u)


def _key_rank(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Dense rank of a column in byte order, null lowest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    coded = column.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank[-1] = 0
    at = pc.fill_null(coded.indices.cast(pa.int64()), len(order)).to_numpy(zero_copy_only=False)
    return rank[at], len(order) + 1


def _combine(columns: list[pa.ChunkedArray], n: int) -> tuple[np.ndarray, int]:
    """One dense code of several columns that orders as their tuple."""
    code, size = np.zeros(n, np.int64), 1
    for c in columns:
        rank, k = _key_rank(c)
        if size * k >= 2**62:
            code, size = _dense(code)
        code, size = code * k + rank, size * k
    return _dense(code)


def cutoffs(group: np.ndarray, n_groups: int, code: np.ndarray, n: int, top: int) -> np.ndarray:
    """Per group the greatest cutoff with at least ``min(n, size)`` codes at or above it.

    Codes are distinct within a group and lie in ``[0, top]``. All groups are bisected
    at once: each round counts, per group, the rows at or above the middle of its
    range; a range is halved until it holds one value. Groups of at most ``n``
    rows keep everything and take no part.
    """
    size = np.bincount(group, minlength=n_groups)
    low = np.zeros(n_groups, np.int64)
    high = np.where(size > n, top, 0)
    rows = np.flatnonzero(size[group] > n)
    g, c = group[rows], code[rows]
    while len(g) and (high > low).any():
        middle = low + (high - low + 1) // 2
        enough = np.bincount(g[c >= middle[g]], minlength=n_groups) >= n
        open_ = high > low
        low = np.where(open_ & enough, middle, low)
        high = np.where(open_ & ~enough, middle - 1, high)
    return low


def top_rows(table: pa.Table, group: list[str], item: list[str], score: str, n: int) -> pa.Table:
    """The rows of the ``n`` best distinct items of every group of ``table``."""
    if not table.num_rows:
        return table
    g, _ = _combine([table[c] for c in group], table.num_rows)
    i, n_items = _combine([table[c] for c in item], table.num_rows)
    s, n_scores = _dense(score_code(table[score].to_numpy()))
    # Higher score first, then the smaller item: both in one order-preserving code.
    bits = int(max(1, n_items - 1)).bit_length()
    code = (s << bits) | ((1 << bits) - 1 - i)
    # An item counts once per group, with its greatest score: the last of its run.
    order = np.lexsort((code, i, g))
    last = np.ones(len(order), bool)
    last[:-1] = (g[order][1:] != g[order][:-1]) | (i[order][1:] != i[order][:-1])
    keep = order[last]
    gk, ck = g[keep], code[keep]
    cut = cutoffs(gk, int(g.max()) + 1, ck, n, int(n_scores << bits))
    return table.take(np.sort(keep[ck >= cut[gk]]))


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    item: list[str],
    score: str,
    n: int,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """The ``n`` items of highest score of every group.

    Output columns: ``group``, ``item`` and ``score`` columns and ``rank`` (from 1).

    Semantics
    - An item is a distinct tuple of the item columns within its group; its greatest
      finite score counts. Rows with a null, NaN or infinite score are no items.
    - Tie rule: score descending, then the item columns ascending in byte
      order, null first. The code is injective, so a group yields exactly
      ``min(n, items)`` rows.
    - A null group column is a group value of its own. An empty table, or one
      without finite scores, gives no rows. Other columns are ignored.

    Method: score and item become one order-preserving integer code. The
    cutoffs of all groups are refined together: each round counts the rows at or
    above the middle of every group's range and halves the ranges, until each
    cutoff leaves exactly ``n`` rows (``cutoffs``).

    Scale: the bisection runs first inside each map task over bounded pieces
    of its rows. An item among a group's best ``n`` is among the best ``n`` of
    whatever piece holds its best row, so nothing is lost, and a group with
    millions of rows sends at most ``n`` rows per piece. One shuffle by group
    follows; its tasks read their rows group by group and hold one bounded piece of them, never a whole group.
    """
    ship(df.sparkSession)
    cols = [*dict.fromkeys([*group, *item, score])]
    if len(cols) != len(group) + len(item) + 1:
        raise ValueError("group, item and score columns must differ")
    rows = df.select(*[F.col(f"`{c}`") for c in cols]).withColumn(score, F.col(f"`{score}`").cast("double"))
    finite = F.col(f"`{score}`").isNotNull() & ~F.isnan(f"`{score}`") & (F.abs(F.col(f"`{score}`")) != float("inf"))
    rows = rows.where(finite)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= rows_at_once:
                yield from top_rows(pa.Table.from_batches(held), group, item, score, n).to_batches()
                held, count = [], 0
        if held:
            yield from top_rows(pa.Table.from_batches(held), group, item, score, n).to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group: finished groups are released, of the one that may go on the best are kept."""
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= rows_at_once:
                t = pa.Table.from_batches(held)
                g, _ = _combine([t[c] for c in group], t.num_rows)
                yield from ranked(top_rows(t.filter(pa.array(g != g[-1])), group, item, score, n))
                rest = top_rows(t.filter(pa.array(g == g[-1])), group, item, score, n)
                held, count = rest.to_batches(), rest.num_rows
        if held:
            yield from ranked(top_rows(pa.Table.from_batches(held), group, item, score, n))

    def ranked(best: pa.Table) -> Iterator[pa.RecordBatch]:
        if not best.num_rows:
            return
        g, _ = _combine([best[c] for c in group], best.num_rows)
        i, _ = _combine([best[c] for c in item], best.num_rows)
        s, _ = _dense(score_code(best[score].to_numpy()))
        order = np.lexsort((i, -s, g))
        start = np.r_[True, g[order][1:] != g[order][:-1]] if len(order) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        rank = (np.arange(len(order)) - begin + 1).astype(np.int32)
        yield from best.take(order).append_column("rank", pa.array(rank)).to_batches()

    keys = [F.col(f"`{c}`") for c in group]
    best = rows.mapInArrow(pieces, schema)
    best = best.repartition(*keys).sortWithinPartitions(*keys)
    return best.mapInArrow(whole, T.StructType([*schema.fields, T.StructField("rank", T.IntegerType(), False)]))
