import math
import random

import numpy as np
import pytest

from tidemark.llm import topn

SCHEMA = "day string, key string, sym string, name string, score double, rank string, code long"


def brute(rows, n):
    best = {}
    for day, key, sym, name, score, *_ in rows:
        if score is None or not math.isfinite(score):
            continue
        g = best.setdefault((day, key), {})
        g[sym, name] = max(score + 0.0, g.get((sym, name), -math.inf))
    low = lambda x: (0, b"") if x is None else (1, x.encode())
    out = set()
    for g, items in best.items():
        order = sorted(items.items(), key=lambda x: (-x[1], low(x[0][0]), low(x[0][1])))
        out |= {(*g, *i, s, k + 1) for k, (i, s) in enumerate(order[:n])}
    return out


@pytest.mark.parametrize("pieces", [7, 64, 100_000])
def test_against_brute_force(spark, pieces):
    rnd = random.Random(pieces)
    scores = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.0, 1.0, 0.5, -2.0, 1e-300]
    names = [None, "", "a", "B", "é", "z", "日本", "aa", "a\U0001f600", "￿"]
    rows = [
        (rnd.choice(["1", "2", None]), rnd.choice(["k", "", None, "q"]), rnd.choice(names), rnd.choice(names), rnd.choice([*scores, rnd.random()]), "x", 5)
        for _ in range(900)
    ]
    rows += [("1", "hot", f"s{rnd.randrange(400)}", "n", rnd.choice([0.1, 0.2, 0.3]), "x", 5) for _ in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = topn.top_n_per_group(df, ["day", "key"], ["sym", "name"], "score", 5, pieces)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topn.top_n_per_group(empty, ["day"], ["sym"], "score", 5).count() == 0
    void = spark.createDataFrame([("1", "k", "s", "n", None, "", 1), ("1", "k", "s", "n", float("nan"), "", 1)], SCHEMA)
    assert topn.top_n_per_group(void, ["day"], ["sym"], "score", 5).count() == 0


def test_score_code_keeps_order():
    x = np.array([-np.inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, np.inf])
    assert (np.diff(topn.score_code(x)) > 0).all()
    assert topn.score_code(np.array([-0.0])) == topn.score_code(np.array([0.0]))


def test_cutoffs_leave_exactly_n():
    rnd = np.random.default_rng(1)
    group = rnd.integers(0, 40, 5000)
    code = rnd.permutation(5000)
    cut = topn.cutoffs(group, 40, code, 9, 5000)
    assert all((code[group == g] >= cut[g]).sum() == 9 for g in range(40))
