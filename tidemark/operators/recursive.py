"""Recursive smoothing of daily series: all entities of a piece advance together, one day per step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 200_000


def lanes(seg: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as a matrix with a row per segment, left-aligned and NaN-padded; and each value's column."""
    start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    col = np.arange(len(seg)) - np.repeat(start, np.diff(np.r_[start, len(seg)]))
    m = np.full((len(start), int(col.max()) + 1), np.nan)
    m[np.cumsum(np.r_[True, seg[1:] != seg[:-1]]) - 1, col] = x
    return m, col


def wilder(m: np.ndarray, period: int) -> np.ndarray:
    """Exponential smoothing with weight 1 / period, seeded by each row's first value. NaN only as padding."""
    out = m.copy()
    for t in range(1, m.shape[1]):
        started = ~np.isnan(out[:, t - 1])
        out[:, t] = np.where(started, out[:, t - 1] + (m[:, t] - out[:, t - 1]) / period, m[:, t])
    return out


def seeded_ema(m: np.ndarray, period: int) -> np.ndarray:
    """Exponential mean with weight 2 / (period + 1), seeded by the plain mean of the first ``period`` values."""
    out = np.full(m.shape, np.nan)
    if m.shape[1] < period:
        return out
    total = np.zeros(m.shape[0])
    for t in range(period):
        total = total + m[:, t]
    out[:, period - 1] = total / period
    a = 2.0 / (period + 1)
    for t in range(period, m.shape[1]):
        out[:, t] = out[:, t - 1] + (m[:, t] - out[:, t - 1]) * a
    return out


def zigzag(high: np.ndarray, low: np.ndarray, size: np.ndarray) -> list[tuple[int, str]]:
    """Turning points (index, ``H`` or ``L``) of one series: a point counts once the price has come back from it by
    ``size``; until then a further extreme of the same kind replaces it. The last row is never one."""
    out: list[tuple[int, str]] = []
    hi = lo = 0
    kind = ""
    for t in range(1, len(high)):
        if kind != "L" and high[t] > high[hi]:
            hi = t
        if kind != "H" and low[t] < low[lo]:
            lo = t
        if kind != "L" and high[hi] - low[t] >= size[t] and hi < t:
            out.append((hi, "H"))
            kind, lo = "L", t
            hi = t
        elif kind != "H" and high[t] - low[lo] >= size[t] and lo < t:
            out.append((lo, "L"))
            kind, hi = "H", t
            lo = t
    return out


def by_entity(df: DataFrame, entity: str, day: str, values: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """Runs ``work(table, segments)`` on pieces of whole entities, sorted by day. One shuffle by entity.

    An entity is never split; its rows are bounded by the calendar, since daily series have one row per day.
    Pieces hold about ``ROWS_AT_ONCE`` rows. Rows with a null entity or day are ignored.
    """
    rows = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(entity, day, *values)
        .repartition(entity)
        .sortWithinPartitions(entity, day)
    )

    def run(t: pa.Table) -> list[pa.RecordBatch]:
        seg = t[entity].combine_chunks().dictionary_encode().indices.to_numpy()
        return work(t, seg).to_batches()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= ROWS_AT_ONCE:
                t = pa.Table.from_batches(held)
                whole = int(np.searchsorted(pc.equal(t[entity], t[entity][-1]).to_numpy(), True))
                if whole:
                    yield from run(t.slice(0, whole))
                    held, count = t.slice(whole).to_batches(), t.num_rows - whole
        if held and count:
            yield from run(pa.Table.from_batches(held))

    return rows.mapInArrow(pieces, schema)


def smoothed_indicators(bars: DataFrame, period: int = 14, ema: int = 21) -> DataFrame:
    """RSI and ATR by recursive smoothing, and a seeded exponential mean, per symbol and day.

    ``bars``: symbol, date, high, low, close; one finite row per (symbol, date). RSI is null for the first ``period``
    rows, 100 where nothing fell; ATR is null for the first ``period - 1`` rows; the exponential mean for the first
    ``2 * ema - 2`` rows.
    """

    def work(t: pa.Table, seg: np.ndarray) -> pa.Table:
        close, col = lanes(seg, t["close"].to_numpy())
        high, low = (lanes(seg, t[c].to_numpy())[0] for c in ("high", "low"))
        move = close[:, 1:] - close[:, :-1]
        gain = wilder(np.where(np.isnan(move), np.nan, np.maximum(move, 0.0)), period)
        loss = wilder(np.where(np.isnan(move), np.nan, np.maximum(-move, 0.0)), period)
        with np.errstate(invalid="ignore", divide="ignore"):
            rsi = np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss))
        rsi = np.hstack([np.full((len(close), 1), np.nan), rsi])
        rsi[:, :period] = np.nan
        before = np.hstack([np.full((len(close), 1), np.nan), close[:, :-1]])
        tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        atr = wilder(tr, period)
        atr[:, : period - 1] = np.nan
        mean = seeded_ema(close, ema)
        mean[:, : 2 * ema - 2] = np.nan
        lane = np.cumsum(np.r_[True, seg[1:] != seg[:-1]]) - 1
        pick = lambda m: pa.array(m[lane, col], mask=np.isnan(m[lane, col]))
        return pa.table({"symbol": t["symbol"], "date": t["date"], "rsi": pick(rsi), "atr": pick(atr), "ema": pick(mean)})

    return by_entity(
        bars, "symbol", "date", ["high", "low", "close"], "symbol string, date date, rsi double, atr double, ema double", work
    )


def turning_points(bars: DataFrame, multiple: float = 2.0, period: int = 14) -> DataFrame:
    """Zig-zag turning points per symbol: reversals of at least ``multiple`` smoothed true ranges."""

    def work(t: pa.Table, seg: np.ndarray) -> pa.Table:
        high, low, close = (t[c].to_numpy() for c in ("high", "low", "close"))
        begin = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        at, kinds = [], []
        for a, b in zip(begin, np.r_[begin[1:], len(seg)]):
            before = np.r_[close[a], close[a : b - 1]]
            tr = np.maximum(high[a:b] - low[a:b], np.maximum(np.abs(high[a:b] - before), np.abs(low[a:b] - before)))
            size = multiple * wilder(tr[None, :], period)[0]
            for i, k in zigzag(high[a:b], low[a:b], size):
                at.append(a + i)
                kinds.append(k)
        idx = pa.array(at, pa.int64())
        price = np.where(np.array(kinds, object) == "H", high[at], low[at]) if at else np.zeros(0)
        return pa.table(
            {"symbol": t["symbol"].take(idx), "date": t["date"].take(idx), "kind": pa.array(kinds, pa.string()), "price": pa.array(price, pa.float64())}
        )

    return by_entity(bars, "symbol", "date", ["high", "low", "close"], "symbol string, date date, kind string, price double", work)
