"""Order-dependent simulation of portfolios: sequential within one, parallel across all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

TRADES = "portfolio string, symbol string, entry_date date, exit_date date, entry double, exit double, shares long, pnl double, reason string"


@dataclass(frozen=True)
class Rules:
    """Parameters of a simulation. They are arguments, not policy."""

    cash: float = 100_000.0
    slots: int = 5
    stop: float = 0.08
    hold: int = 20
    slip: float = 0.0005


def simulate(orders: pa.Table, bars: pa.Table, rules: Rules) -> Iterator[tuple]:
    """Trades of one portfolio. Each day: yesterday's orders fill at the open by rank, open positions leave at their stop, after
    ``hold`` bars, or stay; what is left at the end leaves at its last close.

    Symbols are numbered in their order and the bars sorted by day, so a day is a slice of arrays and a look at a bar is one index.
    """
    if not bars.num_rows:
        return
    names, sym = np.unique(bars["symbol"].to_numpy(zero_copy_only=False), return_inverse=True)
    date = bars["date"].to_numpy().astype("datetime64[D]")
    order = np.lexsort((sym, date))
    sym, date = sym[order], date[order]
    open_, low, close = (bars[c].to_numpy()[order] for c in ("open", "low", "close"))
    days, first = np.unique(date, return_index=True)
    ends = np.r_[first[1:], len(date)]
    number = {s: k for k, s in enumerate(names)}
    wanted: dict = {}
    ranked = orders.sort_by([("date", "ascending"), ("rank", "ascending"), ("symbol", "ascending")])
    for d, s in zip(ranked["date"].to_numpy().astype("datetime64[D]"), ranked["symbol"].to_pylist()):
        if s in number:
            wanted.setdefault(d, []).append(number[s])
    row = np.full(len(names), -1)
    cash, held, pending = rules.cash, {}, []
    for day, lo, hi in zip(days, first, ends):
        row[sym[lo:hi]] = np.arange(lo, hi)
        for s in pending:
            if s in held or len(held) >= rules.slots or row[s] < lo:
                continue
            price = float(open_[row[s]]) * (1 + rules.slip)
            shares = int(min(cash, rules.cash / rules.slots) // price)
            if shares > 0:
                cash -= shares * price
                held[s] = [day, price, shares, price * (1 - rules.stop), 0, day, price]
        for s in sorted(held):
            if row[s] < lo:
                continue
            p, k = held[s], row[s]
            p[4] += 1
            reason = price = None
            if open_[k] <= p[3]:
                reason, price = "gap_stop", float(open_[k])
            elif low[k] <= p[3]:
                reason, price = "stop", p[3]
            elif p[4] >= rules.hold:
                reason, price = "max_hold", float(close[k])
            if reason:
                price *= 1 - rules.slip
                cash += p[2] * price
                yield names[s], p[0], day, p[1], price, p[2], p[2] * (price - p[1]), reason
                del held[s]
            else:
                p[3] = max(p[3], float(close[k]) * (1 - rules.stop))
                p[5], p[6] = day, float(close[k])
        pending = wanted.get(day, [])
    for s in sorted(held):
        p = held[s]
        yield names[s], p[0], p[5], p[1], p[6], p[2], p[2] * (p[6] - p[1]), "end"


def simulated_trades(orders: DataFrame, bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades of every portfolio.

    ``orders``: portfolio, date, symbol, rank; ``bars``: symbol, date, open, high, low, close, one row per key.

    Scale: a portfolio's cash makes its days sequential, so a portfolio is one task; there are as many tasks as
    portfolios. Bars are reduced to the symbols that a portfolio orders before they are sent to it, so that a task
    gets its own symbols' bars and no others.
    """
    ship(bars.sparkSession)
    # Fresh names: both sides come from ``orders``, and a cogroup tells its columns apart by origin.
    wanted = orders.select(F.col("portfolio").alias("owner"), F.col("symbol").alias("wanted")).distinct()
    mine = wanted.join(bars.select("symbol", "date", "open", "high", "low", "close"), F.col("wanted") == F.col("symbol")).drop("wanted")

    kinds = [pa.string(), pa.string(), pa.date32(), pa.date32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
    columns = [c.split(" ")[0] for c in TRADES.split(", ")]

    def run(key: tuple, o: pa.Table, b: pa.Table) -> pa.Table:
        rows = [(key[0].as_py(), *t) for t in simulate(o, b, rules)]
        values = zip(*rows) if rows else [()] * len(columns)
        return pa.table([pa.array([x.item() if isinstance(x, np.generic) else x for x in v], k) for v, k in zip(values, kinds)], names=columns)

    return (
        orders.select("portfolio", "date", "symbol", "rank")
        .groupBy("portfolio")
        .cogroup(mine.groupBy("owner"))
        .applyInArrow(run, TRADES)
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Count, win rate, profit factor, expectancy and exits per portfolio."""
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))
    loss = -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    exits = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("gap_stop", "stop", "max_hold", "end")]
    return trades.groupBy("portfolio").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.when(loss != 0, gain / loss), 5).alias("profit_factor"), F.round(F.avg("pnl"), 4).alias("expectancy"), *exits,
    )
