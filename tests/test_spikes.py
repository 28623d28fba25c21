import datetime as dt

import numpy as np

from tidemark.operators import spikes

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume long, e string, d int, x0 double, reasons int"


def series(seed, n=240, level=50.0):
    r = np.random.default_rng(seed)
    close = level * np.exp(np.cumsum(r.normal(0, 0.015, n)))
    open_ = close * np.exp(r.normal(0, 0.004, n))
    high = np.maximum(open_, close) * (1 + np.abs(r.normal(0, 0.003, n)))
    low = np.minimum(open_, close) * (1 - np.abs(r.normal(0, 0.003, n)))
    return [open_, high, low, close, np.exp(r.normal(13, 0.4, n))]


def rows_of(symbol, cols):
    start = dt.date(2024, 1, 1)
    f = lambda x: None if x is None else float(x)
    return [
        (symbol, start + dt.timedelta(k), *[f(c[k]) for c in cols[:4]], None if cols[4][k] is None else int(cols[4][k]), "x", 1, 2.0, 3)
        for k in range(len(cols[0]))
    ]


def flagged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spikes.implausible_readings(df, "symbol", "date", ("open", "high", "low", "close"), "volume")
    return {(r.symbol, (r.date - dt.date(2024, 1, 1)).days): set(r.reasons) for r in out.collect()}


def test_planted_cases(spark):
    a = [list(c) for c in series(1)]
    for k in range(4):
        a[k][40] *= 100  # a whole bar in the wrong unit
    a[1][60] = a[1][60] * 1.6  # a lone high
    a[4][80] *= 500
    a[4][90] /= 4000
    a[3][100] = float("nan")
    a[0][110] = float("inf")
    a[2][120] = -a[2][120]
    a[1][130] = a[2][130] * 0.9  # contradicts the row
    a[4][140] = -3
    for k in range(150, 157):
        a[3][k] = a[0][k] = a[1][k] = a[2][k] = a[3][150]
    for k in range(170, 176):
        a[4][k] = a[4][170]
    got = flagged(spark, rows_of("A", a))
    assert set(got) == {("A", k) for k in (40, 60, 80, 90, 100, 110, 120, 130, 140, *range(151, 157), *range(171, 176))}
    assert "price_spike" in got["A", 40] and got["A", 60] == {"range_spike"} and got["A", 80] == {"volume_spike"}
    assert got["A", 100] == {"limit"} and got["A", 130] == {"contradiction"} and got["A", 152] == {"stuck_close"}


def test_spikes_of_two_to_four_days(spark):
    rows, want = [], {}
    for size in (2, 3, 4):
        for factor in (100, 0.01):
            a = [np.array(c) for c in series(20 + size)]
            for c in a[:4]:
                c[60 : 60 + size] *= factor
                c[63 + size : 63 + 2 * size] *= factor  # another one soon after
            a[4][120 : 120 + size] *= 300
            a[4][150 : 150 + size] /= 300
            a[4][180:184] *= 5  # busy days
            for c in a[:4]:
                c[200:] *= 0.2  # lasting, and so is the next one
                c[205:] *= 3
            name = f"{size}x{factor}"
            rows += rows_of(name, [list(c) for c in a])
            want |= {(name, k): {"price_spike"} for b in (60, 63 + size) for k in range(b, b + size)}
            want |= {(name, k): {"volume_spike"} for b in (120, 150) for k in range(b, b + size)}
    assert flagged(spark, rows) == want


def test_lasting_changes_and_gaps_are_no_cases(spark):
    a = [np.array(c) for c in series(2)]
    for k in range(4):
        a[k][100:] *= 0.25  # a split
        a[k][180:] *= 10
    a[4][100:] *= 4
    a[4][150] *= 6  # a busy day
    cols = [list(c) for c in a]
    cols[4][50], cols[4][51] = None, 0
    for k in range(200, 210):
        cols[4][k] = 0 if k % 2 else None
    for k in range(210, 218):
        cols[4][k] = 0
    rows = rows_of("B", cols)
    assert flagged(spark, [r for k, r in enumerate(rows) if k not in (20, 21, 22, 130)]) == {}


def test_nulls_empty_and_short_series(spark):
    assert flagged(spark, []) == {}
    short = [list(c) for c in series(3, 5)]
    short[3][2] *= 50
    short[1][2] *= 60
    got = flagged(spark, rows_of("S", short) + [(None, dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1, "", 0, 0.0, 0), ("T", None, 1.0, 1.0, 1.0, 1.0, 1, "", 0, 0.0, 0), ("U", dt.date(2024, 1, 1), None, None, None, None, None, "", 0, 0.0, 0), ("U", dt.date(2024, 1, 2), None, 1.0, 1.0, 0.0, None, "", 0, 0.0, 0)])
    assert got == {("U", 1): {"limit"}, ("S", 2): {"price_spike"}}


def test_pieces_do_not_split_a_source(spark, monkeypatch):
    rows, want = [], set()
    for s in range(12):
        a = [list(c) for c in series(10 + s, 100)]
        for k in range(4):
            a[k][50] *= 30
        rows += rows_of(f"P{s}", a)
        want.add((f"P{s}", 50))
    monkeypatch.setattr(spikes, "ROWS_AT_ONCE", 150)
    assert set(flagged(spark, rows)) == want


def test_runs():
    x = np.array([1, 1, 1, 2, 2, 2, 2, 2, np.nan, np.nan, np.nan, np.nan, np.nan, 2.0])
    seg = np.zeros(len(x), int)
    assert np.flatnonzero(spikes.runs(x, seg, 5)).tolist() == [4, 5, 6, 7]
    assert not spikes.runs(np.full(8, 3.0), np.array([0, 0, 0, 0, 1, 1, 1, 1]), 5).any()


def walk(seed, n, start=50.0):
    rnd = np.random.default_rng(seed)
    return start * np.exp(np.cumsum(rnd.normal(0, 0.01, n)))


def judged(close, open_=None, high=None, volume=None):
    close = np.asarray(close, float)
    open_ = close.copy() if open_ is None else open_
    high = np.maximum(open_, close) * 1.002 if high is None else high
    low = np.minimum(open_, close) * 0.998
    volume = np.random.default_rng(3).integers(9_000, 11_000, len(close)).astype(float) if volume is None else volume
    flags = spikes.judge(np.zeros(len(close), np.int64), open_, high, low, close, volume, spikes.Limits())
    return {r: np.flatnonzero(f).tolist() for r, f in flags.items() if f.any()}


def test_short_sources_have_spikes():
    for n in (3, 5, 7):
        close = walk(n, n)
        assert judged(close) == {}
        close[1] *= 100
        assert judged(close)["price_spike"] == [1]


def test_first_and_last_close():
    close = walk(4, 60)
    close[0] *= 100
    close[-1] /= 100
    assert judged(close)["price_spike"] == [0, 59]
    shifted = walk(5, 60)
    shifted[-1] *= 2  # may last
    assert judged(shifted) == {}


def test_rounds_end_when_nothing_is_left():
    close = walk(6, 700)
    at = np.arange(100, 600, 4)
    close[at] *= np.exp(0.4 + 0.01 * np.arange(len(at)))
    assert judged(close)["price_spike"] == at.tolist()


def test_wrong_open_together_with_its_high():
    close = walk(7, 80)
    open_ = close * 1.001
    open_[40] = close[40] * 3
    high = np.maximum(open_, close) * 1.002
    assert judged(close, open_, high) == {"range_spike": [40]}
