"""Patterns in daily series: contractions between turning points, and folds of a per-day step function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recursive import by_entity


def contractions(points: DataFrame, most: int = 4) -> DataFrame:
    """Falls from a high to the low after it, per symbol, and how each compares with the fall before.

    ``points``: symbol, date, kind (``H`` or ``L``), price, alternating. Output per fall: ``symbol``,
    ``high_date``, ``low_date``, ``depth``, ``ratio`` to the previous depth, ``tightening``: how many falls in a row, this one
    included and ``most`` at most, are each no deeper than three quarters of the one before.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    falls = (
        points.withColumns({"__k": F.lead("kind").over(w), "low_date": F.lead("date").over(w), "__low": F.lead("price").over(w)})
        .where("kind = 'H' AND __k = 'L'")
        .select("symbol", F.col("date").alias("high_date"), "low_date", (1 - F.col("__low") / F.col("price")).alias("depth"))
    )
    v = Window.partitionBy("symbol").orderBy("high_date")
    falls = falls.withColumn("ratio", F.try_divide("depth", F.lag("depth").over(v)))
    tight = F.coalesce((F.col("ratio") <= 0.75).cast("int"), F.lit(0))
    falls = falls.withColumn("__t", tight).withColumn("__run", F.sum(1 - F.col("__t")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "__run").orderBy("high_date").rowsBetween(Window.unboundedPreceding, 0)
    count = F.least(F.lit(most), F.sum("__t").over(run) + 1)
    return falls.select("symbol", "high_date", "low_date", "depth", "ratio", count.alias("tightening"))


Step = Callable[[object, dict], tuple[object, str | None]]


def fold_days(df: DataFrame, entity: str, day: str, values: list[str], step: Step, start: object) -> DataFrame:
    """Folds a step function over each entity's days, in order: ``step(state, row) -> (state, label)``.

    Output: ``entity``, ``day``, ``label`` for the rows whose step gave a label. One shuffle by entity; whole
    entities stream through a task one after another, and a state never leaves it. ``step`` must depend on its arguments only.
    """

    def work(t: pa.Table, seg: np.ndarray) -> pa.Table:
        columns = {v: t[v].to_pylist() for v in values}
        at, labels, state, last = [], [], start, -1
        for i, s in enumerate(seg.tolist()):
            if s != last:
                state, last = start, s
            state, label = step(state, {v: c[i] for v, c in columns.items()})
            if label is not None:
                at.append(i)
                labels.append(label)
        idx = pa.array(at, pa.int64())
        return pa.table({entity: t[entity].take(idx), day: t[day].take(idx), "label": pa.array(labels, pa.string())})

    return by_entity(df, entity, day, values, f"{entity} string, {day} date, label string", work)


def rally_step(state: tuple | None, row: dict) -> tuple[tuple | None, str | None]:
    """A rally attempt after a fall, confirmed by a strong day on rising volume on its fourth to tenth day.

    State: (phase, day of the attempt, low of its first day, close before, volume before, highest close).
    """
    phase, n, low, before, volume, top = state or ("none", 0, None, None, None, row["close"])
    c, v = row["close"], row["volume"]
    top = max(top, c)
    label = None
    gain = c / before - 1 if before else 0.0
    if phase == "none":
        if c <= 0.92 * top:
            phase, label = "fallen", "fallen"
    elif phase == "fallen":
        if gain > 0:
            phase, n, low, label = "attempt", 1, row["low"], "attempt"
    elif phase == "attempt":
        n += 1
        if row["low"] < low:
            phase, n, label = "fallen", 0, "undercut"
        elif 4 <= n <= 10 and gain >= 0.0125 and v > volume:
            phase, top, label = "none", c, "confirmed"
        elif n > 10:
            phase, n, label = "fallen", 0, "expired"
    return (phase, n, low, c, v, top), label
