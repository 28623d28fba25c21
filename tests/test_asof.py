import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators.asof import PersistentTree, known_as_of

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
EVENTS = "id int, sym string, at date, top date, day string, shard int, e0 string"
FACTS = "sym string, known date, valid date, acc string, salt int, top string"


def test_every_version_of_the_tree():
    rnd = np.random.default_rng(2)
    for n, ranks in ((1, 1), (2, 2), (3, 3), (8, 8), (33, 33), (100, 100), (50, 7), (20, 1)):
        order = rnd.permutation(n) if n == ranks else rnd.integers(0, ranks, n)
        tree = PersistentTree(order)
        roots, keys = (x.ravel() for x in np.meshgrid(np.arange(-1, n), np.arange(-1, order.max() + 1)))
        rank, version = tree.floor(roots, keys)
        for r, k, g, v in zip(roots, keys, rank, version):
            want = max((x for x in order[: r + 1] if x <= k), default=-1)
            assert g == want
            assert v == max((j for j in range(r + 1) if order[j] == want), default=-1)  # the last one that put the leaf


@pytest.mark.parametrize("per_shard", [2, 10_000])
@pytest.mark.parametrize("limit", [None, "top"])
@pytest.mark.parametrize("valid", [["valid", "acc"], ["valid"]])
def test_against_brute_force(spark, per_shard, limit, valid):
    rnd = random.Random(11)
    maybe = lambda x: None if rnd.random() < 0.05 else x
    facts = [(maybe(rnd.choice("ABCD")), maybe(DAY(rnd.randrange(40))), maybe(DAY(rnd.randrange(30))), f"a{k}", 1, "x") for k in range(150)]
    facts += facts[:20]
    events = [(k, maybe(rnd.choice("ABCDE")), maybe(DAY(rnd.randrange(45))), DAY(rnd.randrange(30)), "d", 3, "e") for k in range(200)]
    e, f = spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS)
    f = f.withColumnRenamed("top", "extra")
    out = known_as_of(e, f, ["sym"], "at", "known", valid, ["acc", "valid"], limit, shards=3, per_shard=per_shard).collect()
    assert len(out) == len(events) and out[0].asDict().keys() >= {"id", "shard", "acc", "valid"}
    low = lambda x: (x is not None, x)
    for r in out:
        seen = [
            (low(v), kn if valid == ["valid"] else None, a) for s, kn, v, a, *_ in facts
            if s is not None and s == r.sym and kn is not None and r["at"] is not None and kn <= r["at"] and (limit is None or v is None or v <= r.top)
        ]
        best = max(seen, default=None, key=lambda x: x if x[1] else (x[0], x[2]))
        assert (r.acc, r.valid) == ((best[2], best[0][1]) if best else (None, None))


def test_a_correction_is_not_seen_before_its_day(spark):
    f = spark.createDataFrame([("A", DAY(9), DAY(0), 100), ("A", DAY(40), DAY(0), 999), ("A", DAY(40), DAY(0), 7), ("A", DAY(50), DAY(0), 5)], "sym string, known date, valid date, x int")
    e = spark.createDataFrame([("A", DAY(k)) for k in (8, 9, 30, 39, 40, 49, 50, 60)], "sym string, at date")
    for n in (1, 1000):
        got = {r["at"]: r.x for r in known_as_of(e, f, ["sym"], "at", "known", ["valid"], ["x"], per_shard=n).collect()}
        assert [got[DAY(k)] for k in (8, 9, 30, 39, 40, 49, 50, 60)] == [None, 100, 100, 100, 999, 999, 5, 5]


def test_plan_has_few_exchanges(spark):
    f = spark.range(1000).selectExpr("cast(id % 50 as string) sym", "date_add(date'2024-01-01', cast(id % 90 as int)) known", "date_add(date'2023-01-01', cast(id as int)) valid", "id x")
    e = spark.range(1000).selectExpr("cast(id % 50 as string) sym", "date_add(date'2024-01-01', cast(id % 70 as int)) at")
    plan = known_as_of(e, f, ["sym"], "at", "known", ["valid"], ["x"])._jdf.queryExecution().sparkPlan().toString()
    prepared = known_as_of(e, f, ["sym"], "at", "known", ["valid"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and prepared.count("Exchange hashpartitioning") <= 6


def test_nothing_later_and_empty_sides(spark):
    e = spark.createDataFrame([(1, "A", DAY(5), None, "", 0, "")], EVENTS)
    f = spark.createDataFrame([("A", DAY(6), DAY(1), "late", 0, "")], FACTS).drop("top")
    none = spark.createDataFrame([], f.schema)
    for facts in (f, none):
        assert [r.acc for r in known_as_of(e, facts, ["sym"], "at", "known", ["valid"], ["acc"]).collect()] == [None]
    assert known_as_of(e.limit(0), f, ["sym"], "at", "known", ["valid"], ["acc"]).count() == 0


def test_clashing_payload_is_refused(spark):
    e = spark.createDataFrame([(1, "A", DAY(5), None, "", 0, "")], EVENTS)
    f = spark.createDataFrame([("A", DAY(1), DAY(1), "x", 0, "")], FACTS)
    with pytest.raises(ValueError):
        known_as_of(e, f, ["sym"], "at", "known", ["valid"], ["top"])


def test_both_sides_may_come_from_one_frame(spark):
    df = spark.createDataFrame([("A", DAY(k), f"a{k}") for k in range(5)] * 2, "sym string, day date, acc string")
    events = df.select("sym", "day").distinct()
    out = known_as_of(events, df, ["sym"], "day", "day", ["day"], ["acc"]).collect()
    assert {(r.day, r.acc) for r in out} == {(DAY(k), f"a{k}") for k in range(5)} and len(out) == 5
    twice = known_as_of(known_as_of(events, df, ["sym"], "day", "day", ["day"], ["acc"]), df.withColumnRenamed("acc", "b"), ["sym"], "day", "day", ["day"], ["b"])
    assert all(r.acc == r.b for r in twice.collect())
