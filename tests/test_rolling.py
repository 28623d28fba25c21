import datetime as dt
import math
import random

from tidemark.operators.rolling import trailing_totals

SCHEMA = "symbol string, date date, volume long, close double, __n int, age string, w string"


def brute(rows, lengths):
    by = {}
    for s, d, v, c in rows:
        by.setdefault(s, {})[d] = (v, c)
    out = {}
    for s, days in by.items():
        d = min(days)
        while d <= max(days):
            for n in lengths:
                span = [days[x] for k in range(n) if (x := d - dt.timedelta(k)) in days]
                vols, closes = [v for v, _ in span if v is not None], [c for _, c in span if c is not None]
                out[s, d, n] = (sum(vols), len(vols), sum(closes), len(closes))
            d += dt.timedelta(1)
    return out


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9 * max(1, abs(b))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows, start = [], dt.date(2024, 2, 20)
    for s, count in (("A", 90), ("B", 40), ("C", 1), ("é", 7)):
        days = sorted(rnd.sample(range(150), count))
        for d in days:
            v = None if rnd.random() < 0.1 else rnd.choice([0, -5, rnd.randrange(10**6), 10**15])
            c = None if rnd.random() < 0.1 else rnd.choice([1.5, 2.25, 1e300, float("nan"), float("inf")]) if rnd.random() < 0.05 else rnd.random()
            rows.append((s, start + dt.timedelta(d), v, c))
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)
    got = trailing_totals(df, "symbol", "date", ["volume", "close"], [1, 7, 30]).collect()
    want = brute(rows, [1, 7, 30])
    assert len(got) * 3 == len(want)
    for r in got:
        for n in (1, 7, 30):
            v, nv, c, nc = want[r.symbol, r.date, n]
            assert (r[f"volume_sum_{n}"], r[f"volume_cnt_{n}"], r[f"close_cnt_{n}"]) == (v, nv, nc)
            assert same(r[f"close_sum_{n}"], float(c)), (r.symbol, r.date, n)


def test_a_spike_does_not_outlive_its_period(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(k), 1, float("inf") if k == 3 else 1.0, 0, "", "") for k in range(20)]
    got = trailing_totals(spark.createDataFrame(rows, SCHEMA), "symbol", "date", ["close"], [7]).orderBy("date").collect()
    assert [math.isinf(r.close_sum_7) for r in got] == [3 <= k < 10 for k in range(20)]


def test_overflow_is_null(spark):
    rows = [("A", dt.date(2024, 1, 1 + k), 2**62, 1.0, 0, "", "") for k in range(5)]
    got = trailing_totals(spark.createDataFrame(rows, SCHEMA), "symbol", "date", ["volume"], [7]).orderBy("date").collect()
    assert [r.volume_sum_7 for r in got] == [2**62, None, None, None, None]


def test_empty_and_null_keys(spark):
    rows = [(None, dt.date(2024, 1, 1), 1, 1.0, 0, "", ""), ("A", None, 1, 1.0, 0, "", "")]
    assert trailing_totals(spark.createDataFrame([], SCHEMA), "symbol", "date", ["volume"], [7]).count() == 0
    assert trailing_totals(spark.createDataFrame(rows, SCHEMA), "symbol", "date", ["volume"], [7]).count() == 0
