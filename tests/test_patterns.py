import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.operators import patterns, portfolio, recursive

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)


def test_zigzag_alternates_and_skips_small_moves():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        close = 100 + np.cumsum(rnd.normal(0, 1, 200))
        size = np.full(200, 4.0)
        points = recursive.zigzag(close, close, size)
        assert all(a[1] != b[1] and a[0] < b[0] for a, b in zip(points, points[1:]))
        for (i, k), (j, _) in zip(points, points[1:]):
            assert (close[i] - close[j] if k == "H" else close[j] - close[i]) >= 4.0
            part = close[i : j + 1]
            assert close[i] == (part.max() if k == "H" else part.min())
        assert all(i < 199 for i, _ in points)


def test_contractions(spark):
    rows = [("A", DAY(k), kind, price) for k, (kind, price) in enumerate([("L", 80.0), ("H", 100.0), ("L", 80.0), ("H", 100.0), ("L", 88.0), ("H", 100.0), ("L", 95.0), ("H", 100.0), ("L", 90.0), ("H", 101.0)])]
    df = spark.createDataFrame(rows, "symbol string, date date, kind string, price double")
    got = [(round(r.depth, 4), r.tightening) for r in patterns.contractions(df).orderBy("high_date").collect()]
    assert got == [(0.2, 1), (0.12, 2), (0.05, 3), (0.1, 1)]
    assert patterns.contractions(df.limit(0)).count() == 0


def test_fold_is_per_entity_and_in_order(spark, monkeypatch):
    def step(state, row):
        n = (state or 0) + row["x"]
        return n, str(n) if row["x"] else None

    rows = [(f"S{s}", DAY(k), k % 3, s) for s in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "e string, d date, x int, label int").repartition(4)
    monkeypatch.setattr(recursive, "ROWS_AT_ONCE", 55)
    got = patterns.fold_days(df, "e", "d", ["x"], step, None).collect()
    want = {(f"S{s}", DAY(k)): str(sum(j % 3 for j in range(k + 1))) for s in range(6) for k in range(40) if k % 3}
    assert {(r.e, r.d): r.label for r in got} == want


def test_rally_states():
    closes = [100, 100, 90, 91, 91.5, 92, 93.5, 94]
    volumes = [1, 1, 1, 1, 1, 1, 2, 1]
    state, labels = None, []
    for c, v in zip(closes, volumes):
        state, label = patterns.rally_step(state, {"close": float(c), "low": c - 0.5, "volume": v})
        labels.append(label)
    assert labels == [None, None, "fallen", "attempt", None, None, "confirmed", None]


def test_simulation_by_hand(spark):
    price = {"A": [10, 10, 10.5, 11, 8, 8], "B": [20, 20, 20, 20, 20, 20], "C": [5] * 6}
    bars = [(s, DAY(k), float(p), p + 0.1, p - 0.1, float(p)) for s, ps in price.items() for k, p in enumerate(ps)]
    b = spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double")
    orders = spark.createDataFrame([("p", DAY(0), "A", 1), ("p", DAY(0), "B", 2), ("p", DAY(0), "C", 3), ("q", DAY(4), "B", 1), ("r", DAY(0), "Z", 1)], "portfolio string, date date, symbol string, rank int")
    rules = portfolio.Rules(cash=1000.0, slots=2, stop=0.08, hold=3, slip=0.0)
    got = {(r.portfolio, r.symbol): (r.entry_date, r.exit_date, r.shares, round(r.pnl, 6), r.reason) for r in portfolio.simulated_trades(orders, b, rules).collect()}
    assert got == {
        ("p", "A"): (DAY(1), DAY(3), 50, 50.0, "max_hold"),
        ("p", "B"): (DAY(1), DAY(3), 25, 0.0, "max_hold"),
        ("q", "B"): (DAY(5), DAY(5), 25, 0.0, "end"),
    }
    assert portfolio.simulated_trades(orders.limit(0), b, rules).count() == 0
    m = portfolio.trade_metrics(portfolio.simulated_trades(orders, b, rules)).collect()
    assert {r.portfolio: (r.n, r.n_max_hold, r.n_end) for r in m} == {"p": (2, 2, 0), "q": (1, 0, 1)}


def test_gap_and_stop():
    bars = pd.DataFrame([("A", DAY(k), o, o, low, c) for k, (o, low, c) in enumerate([(10, 10, 10), (10, 10, 10), (10, 9, 9.5), (8, 8, 8)])], columns=["symbol", "date", "open", "high", "low", "close"])
    orders = pd.DataFrame([("p", DAY(0), "A", 1)], columns=["portfolio", "date", "symbol", "rank"])
    run = lambda stop: list(portfolio.simulate(pa.Table.from_pandas(orders, preserve_index=False), pa.Table.from_pandas(bars, preserve_index=False), portfolio.Rules(cash=100.0, slots=1, stop=stop, hold=9, slip=0.0)))
    assert [(t[2], t[4], t[7]) for t in run(0.08)] == [(DAY(2), pytest.approx(9.2), "stop")]
    assert [(t[2], t[4], t[7]) for t in run(0.15)] == [(DAY(3), 8, "gap_stop")]
