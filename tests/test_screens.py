import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import screens

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)


def rule(name, test, needs=None, warm_up=1):
    return screens.Rule(name, needs or {}, test, warm_up)


def test_registry_and_composition():
    f, s = screens.Registry(), screens.Registry()
    f.add(rule("a", lambda: F.col("x") > 0, warm_up=30))
    s.add(rule("b", lambda: F.col("y") > 0, warm_up=5))
    with pytest.raises(ValueError):
        f.add(rule("a", lambda: F.lit(True)))
    with pytest.raises(KeyError):
        screens.compose("t", ["none"], ["b"], f, s)
    assert screens.compose("t", ["a"], ["b"], f, s).warm_up == 30 and f.names() == ["a"]


def test_states_and_orders(spark):
    strategy = screens.Strategy("t", (rule("up", lambda: F.col("__twice") > 0, {"twice": lambda: F.col("x") * 2}),), (rule("one", lambda: F.col("y") == 1), rule("odd", lambda: F.col("y") % 2 == 1)))
    rows = [("A", DAY(9), 1, 1), ("B", DAY(9), 1, 3), ("C", DAY(9), 1, 2), ("D", DAY(9), 0, 1), ("E", DAY(9), None, 1), ("F", DAY(9), 1, None), ("G", DAY(1), 1, 1), ("H", DAY(10), 1, 1)]
    df = spark.createDataFrame(rows, "symbol string, date date, x int, y int")
    t = screens.screened(screens.FolderBars(df), strategy, 5, lambda: DAY(9))
    got = {r.symbol: (r.state, r.rejected_by, list(r.signals)) for r in t.collect()}
    assert got == {
        "A": ("hit", None, ["one", "odd"]), "B": ("hit", None, ["odd"]), "C": ("miss", None, []), "D": ("filtered", "up", []), "E": ("no_data", "up", []), "F": ("no_data", None, []),
    }
    orders = screens.FirstSignal("y").orders(t.where("state = 'hit'")).collect()
    assert {(r.portfolio, r.symbol, r["rank"]) for r in orders} == {("one", "A", 1), ("odd", "B", 1), ("odd", "A", 2)}
    assert screens.screen(df.limit(0), strategy).count() == 0
