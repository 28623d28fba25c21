import datetime as dt
import random

from tidemark.operators import positions

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
STATE = "id int, symbol string, entry double, stop double, held int, marked date, price double, reason string"


def bars_of(rnd, days):
    rows = []
    for symbol in "AB":
        close = 100.0
        for k in range(days):
            if k > 2 and rnd.random() < 0.1:
                continue
            open_ = close * (1 + rnd.gauss(0, 0.02))
            close = open_ * (1 + rnd.gauss(0, 0.02))
            rows.append((symbol, DAY(k), open_, min(open_, close) * 0.99, close))
    return rows


def brute(entry, stop, bars, hold, keep):
    last = None
    for n, (day, open_, low, close) in enumerate(bars, 1):
        if open_ <= stop:
            return (n, day, open_, "gap_stop")
        if low <= stop:
            return (n, day, stop, "stop")
        if n >= hold:
            return (n, day, close, "max_hold")
        stop = max(stop, close * keep)
        last = (n, day, close, None)
    return last


def test_in_one_go_and_day_by_day(spark):
    rnd = random.Random(3)
    bars = bars_of(rnd, 60)
    schema = "symbol string, date date, open double, low double, close double"
    of = {s: [(d, o, l, c) for x, d, o, l, c in bars if x == s] for s in "AB"}
    seeds = []
    for k in range(12):
        s = rnd.choice("AB")
        d, _, _, c = rnd.choice(of[s][:40])
        seeds.append((k, s, c, c * 0.95, 0, d, None, None))
    seeds += [(90, "C", 1.0, 0.9, 0, DAY(0), None, None), (91, "A", None, None, 0, DAY(0), None, None)]
    state = spark.createDataFrame(seeds, STATE)
    whole = positions.advance(state, spark.createDataFrame(bars, schema), ["id"], 15, 0.95)
    got = {r.id: (r.held, r.marked, r.price, r.reason) for r in whole.collect()}
    for i, s, entry, stop, _, marked, *_ in seeds:
        want = brute(entry, stop, [b for b in of.get(s, []) if b[0] > marked], 15, 0.95) if entry else None
        assert got[i] == (want or (0, marked, None, None))
    step = state
    for until in (25, 44, 60):
        step = spark.createDataFrame(positions.advance(step, spark.createDataFrame([b for b in bars if b[1] < DAY(until)], schema), ["id"], 15, 0.95).select("id", "symbol", "entry", "stop", "held", "marked", "price", "reason").collect(), STATE)
    assert {r.id: (r.held, r.marked, r.price, r.reason) for r in step.collect()} == got


def test_empty(spark):
    state = spark.createDataFrame([], STATE)
    assert positions.advance(state, spark.createDataFrame([], "symbol string, date date, open double, low double, close double"), ["id"], 5, 0.9).count() == 0
