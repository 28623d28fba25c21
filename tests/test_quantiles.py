import random

import numpy as np

from tidemark.operators.quantiles import exact_quantiles


def test_against_numpy(spark):
    rnd = random.Random(5)
    draw = [lambda: rnd.gauss(0, 5), lambda: rnd.choice([-1.0, 0.0, -0.0, 2.5]), lambda: rnd.expovariate(1e-9), lambda: 7.0]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(draw)(), 1) for _ in range(3000)]
    rows += [("hot", rnd.choice(draw)(), 1) for _ in range(3000)] + [("one", 3.0, 1), ("void", None, 1), ("void", float("nan"), 1)]
    df = spark.createDataFrame(rows, "key string, x double, n int").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.key: (r.n, r.quantiles) for r in exact_quantiles(df, ["key"], "x", probs).collect()}
    assert set(got) == {"a", "b", None, "hot", "one"}
    for key, (n, q) in got.items():
        values = [x for k, x, _ in rows if k == key]
        assert n == len(values) and np.allclose(q, np.quantile(values, probs), rtol=1e-12, atol=1e-12)


def test_without_groups_and_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert [r.quantiles for r in exact_quantiles(df, [], "x", [0.5, 0.75]).collect()] == [[2.0, 3.0]]
    assert exact_quantiles(df.limit(0), [], "x", [0.5]).count() == 0
