import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions.text import spelling_key
from tidemark.operators.snapshots import snapshot_changes

SCHEMA = "day date, sym string, name string, sector string, snap string, k1 string, bucket int, side int, change string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, "c") for r in rows], SCHEMA)
    compared = {c: spelling_key(F.col(c)) for c in ("name", "sector")}
    out = snapshot_changes(df, "day", ["sym"], compared, ["name"], **kw)
    return sorted((r.day, r.sym, r.change) for r in out.collect())


def brute(rows):
    fold = lambda x: None if x is None else " ".join(x.split()).lower()
    snaps = {}
    for d, s, n, g in rows:
        if d is not None and s is not None:
            snaps.setdefault(d, {}).setdefault(s, set()).add((fold(n), fold(g)))
    days, out = sorted(snaps), []
    for a, b in zip(days, days[1:]):
        p, q = snaps[a], snaps[b]
        out += [(b, s, "added") for s in q.keys() - p.keys()] + [(b, s, "removed") for s in p.keys() - q.keys()]
        out += [(b, s, "changed") for s in p.keys() & q.keys() if p[s] != q[s]]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for k in (0, 3, 4, 30, 90):
        for s in range(60):
            if rnd.random() < 0.8:
                name = rnd.choice(["Alpha Corp", " alpha  corp", "ALPHA CORP ", "Beta", None, ""])
                rows += [(dt.date(2024, 1, 1) + dt.timedelta(k), f"S{s}", name, rnd.choice(["Energy", "energy", None]))] * rnd.choice([1, 1, 2])
    rows += [(dt.date(2024, 1, 4), None, "x", "y"), (None, "S1", "x", "y")]
    assert run(spark, rows, buckets=7) == brute(rows)
    assert run(spark, rows, buckets=1) == brute(rows)


def test_null_differs_from_a_value_only(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [(a, "N", None, "E"), (b, "N", None, "E"), (a, "V", None, "E"), (b, "V", "v", "E"), (a, "X", "", "E"), (b, "X", None, "E")]
    assert run(spark, rows) == [(b, "V", "changed"), (b, "X", "changed")]


def test_empty_and_single_snapshot(spark):
    assert run(spark, []) == []
    assert run(spark, [(dt.date(2024, 1, 1), "A", "a", "b")]) == []


def test_old_and_new_values(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    df = spark.createDataFrame([(a, "A", "one", "s"), (b, "A", "two", "s"), (a, "B", "gone", "s")], "day date, sym string, name string, sector string")
    out = snapshot_changes(df, "day", ["sym"], {"name": F.col("name")}, ["name"]).collect()
    assert {(r.sym, r.old_name, r.new_name) for r in out} == {("A", "one", "two"), ("B", "gone", None)}
