import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import exact, shaping, stats
from tidemark.functions.text import blank_to_null, spelling_key
from tidemark.operators import dedupe, recursive, sampling
from tidemark.operators import series as S

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def walk(spark):
    rnd = random.Random(12)
    rows = []
    for s in "AB":
        p = 50.0
        for k in range(120):
            p = round(p * (1 + rnd.gauss(0, 0.02)), 2)
            rows.append((s, DAY(k), p, round(p * 1.01, 2), round(p * 0.99, 2), p, rnd.randrange(1, 10**6)))
    return spark.createDataFrame(rows, SCHEMA).cache()


def indicators(df):
    smooth = recursive.smoothed_indicators(df)
    cols = df.select(
        "symbol", "date", S.sma("close", 20).alias("sma"), S.trailing_mean("volume", 5).alias("vol"), S.pct_change("close", 3).alias("chg"),
        S.rolling_extreme("close", 30, 10, "max").alias("hi"), S.drawdown("close").alias("dd"),
    )
    return {(r.symbol, r.date): r for r in cols.join(smooth, ["symbol", "date"]).collect()}


def test_no_row_depends_on_later_rows(walk):
    whole = indicators(walk)
    for cut in (30, 77):
        part = indicators(walk.where(F.col("date") <= F.lit(DAY(cut))))
        assert len(part) == 2 * (cut + 1)
        assert all(whole[k] == r for k, r in part.items())


def test_smoothing_against_plain_loops(walk):
    rows = sorted((r for r in walk.collect() if r.symbol == "A"), key=lambda r: r.date)
    got = {r.date: r for r in recursive.smoothed_indicators(walk).where("symbol = 'A'").collect()}
    gain = loss = atr = ema = None
    for k, r in enumerate(rows):
        before = rows[k - 1].close if k else None
        tr = r.high - r.low if k == 0 else max(r.high - r.low, abs(r.high - before), abs(r.low - before))
        atr = tr if atr is None else atr + (tr - atr) / 14
        if k:
            up, down = max(r.close - before, 0.0), max(before - r.close, 0.0)
            gain, loss = (up, down) if gain is None else (gain + (up - gain) / 14, loss + (down - loss) / 14)
        if k == 20:
            ema = sum(x.close for x in rows[:21]) / 21
        elif k > 20:
            ema += (r.close - ema) * 2 / 22
        g = got[r.date]
        assert (g.atr is None) == (k < 13) and (g.rsi is None) == (k < 14) and (g.ema is None) == (k < 40)
        if k >= 40:
            assert g.atr == pytest.approx(atr) and g.ema == pytest.approx(ema) and g.rsi == pytest.approx(100 - 100 / (1 + gain / loss))


def test_nothing_fell(spark):
    df = spark.createDataFrame([("A", DAY(k), 1.0 * k + 1, 1.0 * k + 2, 1.0 * k + 1, 1.0 * k + 1, 1) for k in range(20)], SCHEMA)
    assert recursive.smoothed_indicators(df).orderBy("date").collect()[-1].rsi == 100.0
    assert recursive.smoothed_indicators(df.limit(0)).count() == 0


def test_percentiles_share_ranks(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 2.0, 3.0, None)] + [("one", 5.0)], "g string, x double")
    got = sorted(((r.g, r.x, r.p) for r in S.percentile_rank(df, "x", ["g"], "p").collect()), key=str)
    assert got == [("g", 1.0, 0.0), ("g", 2.0, 0.5), ("g", 2.0, 0.5), ("g", 3.0, 1.0), ("g", None, None), ("one", 5.0, 0.5)]


def test_streaks_and_episodes(spark):
    df = spark.createDataFrame([("A", DAY(k), x) for k, x in enumerate([1.0, 2.0, 3.0, None, 4.0, 4.0, 5.0, 1.0])], "symbol string, date date, x double")
    assert [r.n for r in S.rising_streak(df, "x", "n").orderBy("date").collect()] == [0, 1, 2, 3, 0, 1, 0]
    lev = df.withColumn("level", F.when(F.col("x") > 2, "hi").when(F.col("x") <= 2, "lo"))
    assert [r.n for r in S.episodes(lev, "level", "n").orderBy("date").collect()] == [1, 1, 2, 3, 4, 4, 4, 5]


def test_keep_last_is_deterministic(spark):
    rows = [("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("k", None, "z"), (None, 5, "n"), ("only null", None, None)]
    df = spark.createDataFrame(rows, "key string, t int, v string")
    for n in (1, 3):
        got = {(r.key, r.t, r.v) for r in dedupe.keep_last(df.repartition(n), ["key"], ["t"]).collect()}
        assert got == {("k", 2, "c"), (None, 5, "n"), ("only null", None, None)}
    assert dedupe.keep_last(df.limit(0), ["key"], ["t"]).count() == 0


def test_quotas_and_samples(spark):
    sizes = {"a": 50, "b": 30, "c": 15, "d": 5, None: 1}
    df = spark.createDataFrame([(s, f"{s}{k}") for s, n in sizes.items() for k in range(n)], "stratum string, key string")
    q = {r.stratum: r.quota for r in sampling.quotas(df, "stratum", 20).collect()}
    assert sum(q.values()) == 20 and q["a"] == 10 and q["b"] == 6 and q["c"] == 3
    small = {r.key for r in sampling.stratified_sample(df, "stratum", "key", 10, "s").collect()}
    large = {r.key for r in sampling.stratified_sample(df.repartition(3), "stratum", "key", 40, "s").collect()}
    assert len(small) == 10 and len(large) == 40 and small <= large
    assert sampling.quotas(df.limit(0), "stratum", 5).count() == 0


def test_business_days(spark):
    pairs = [(DAY(a), DAY(a + b)) for a in range(9) for b in range(-3, 40)]
    df = spark.createDataFrame(pairs, "a date, b date")
    for r in df.select("a", "b", stats.business_days(F.col("a"), F.col("b")).alias("n")).collect():
        want = np.busday_count(r.a + dt.timedelta(1), r.b + dt.timedelta(1)) if r.b > r.a else 0
        assert r.n == want
    one = spark.createDataFrame([(None, DAY(1))], "a date, b date")
    assert one.select(stats.business_days(F.col("a"), F.col("b")).alias("n")).first().n is None


def test_intervals(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "h long, n long")
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    got = df.select(F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi")).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.0, 0.2775), (0.7225, 1.0), (0.2366, 0.7634)]
    assert df.select(stats.clamp01(F.lit(1.5)).alias("x")).first().x == 1.0


def test_text_functions(spark):
    rows = [("  A  b\tC ", "é"), ("", "ab"), (None, "x"), (" 　", None)]
    df = spark.createDataFrame(rows, "t string, s string")
    got = df.select(spelling_key(F.col("t")).alias("k"), blank_to_null(F.col("t")).alias("b")).collect()
    assert [r.k for r in got] == ["a b c", "", None, ""] and [r.b for r in got][1:3] == [None, None]
    m = spark.createDataFrame([("AB ABC xAB AB. (AB)", "AB"), ("x", ""), (None, "A"), ("A+B A+B", "A+B")], "t string, s string")
    assert [r.n for r in m.select(shaping.mentions(F.col("t"), F.col("s")).alias("n")).collect()] == [3, None, None, 2]
    f = spark.createDataFrame([("Ｆｕｌｌ “Q” – x…",), (None,)], "t string")
    assert [r.x for r in f.select(shaping.folded("t").alias("x")).collect()] == ['full "q" - x...', None]
    cut = spark.createDataFrame([("a" * 30,), ("a" * 50 + "b" * 50,), (None,)], "t string").select(shaping.head_tail(F.col("t"), 40, 0.75).alias("x")).collect()
    assert [r.x for r in cut] == ["a" * 30, "a" * 30 + shaping.MARKER + "b" * 10, None]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(12, 60))
def test_chunks_join_to_the_text(text, cap):
    import json

    parts = shaping.chunks(text, cap)
    assert "".join(parts) == text and all(len(json.dumps(p, ensure_ascii=False)) <= cap for p in parts)


@settings(max_examples=300, deadline=None)
@given(*[st.floats(0.01, 1e7, allow_nan=False)] * 3, st.floats(0.0001, 0.5), st.floats(0.01, 1.0))
def test_sizes_never_exceed_the_budget(equity, entry, drop, risk, cap):
    stop = entry - drop
    n = exact.share_count(equity, entry, stop, risk, cap)
    if stop >= entry:
        assert n is None
        return
    E, P, R, C = map(Fraction, (equity, entry, risk, cap))
    assert n * (P - Fraction(stop)) <= E * R and n * P <= E * C
    assert (n + 1) * (P - Fraction(stop)) > E * R or (n + 1) * P > E * C


def test_canonical_forms():
    assert exact.canonical('{"b": 1, "a": [1, 2]}') == exact.canonical('"{\\"a\\":[1,2],\\"b\\":1}"') == '{"a":[1,2],"b":1}'
    assert exact.canonical("{") is None and exact.canonical(None) is None
    assert exact.share_count(1.0, 0.0, -1.0, 0.1, 0.1) is None and exact.share_count(float("nan"), 1, 0.5, 0.1, 0.1) is None
