"""Positions that are independent of each other, carried on over new bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marks(state: DataFrame, bars: DataFrame, ids: list[str], hold: int, keep: float) -> DataFrame:
    """One row per open position and later bar, up to the bar on which it ends.

    ``state``: ``ids``, ``symbol``, ``entry``, ``stop``, ``held`` (bars since entry), ``marked`` (day of the last bar that was seen). ``bars``:
    symbol, date, open, low, close, one row per key. Output: ``ids``, ``symbol``, ``entry``, ``date``, ``held``, ``stop``, ``price`` and ``reason``: ``gap_stop`` (opens
    at or below the stop; the open is the price), ``stop`` (falls to it; the stop is the price), ``max_hold`` (the ``hold``-th bar; its close), or null
    while the position stays open (the close). The stop rises to ``keep`` times each close, from the bar after it on.

    Semantics: a position whose ``marked`` day has no bar of its symbol, or whose symbol or entry is null, gives no rows. Empty sides give none.

    Scale: bars are numbered per symbol, and a position asks for its next ``hold - held`` numbers, so it meets at most ``hold`` bars by an equal
    join; the days of a position follow each other in a window, and all positions run in parallel.
    """
    numbered = bars.select(
        "symbol", "date", "open", "low", "close", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("rn")
    )
    at = state.where("entry IS NOT NULL").join(numbered.select("symbol", F.col("date").alias("marked"), F.col("rn").alias("rn0")), ["symbol", "marked"])
    steps = F.sequence(F.lit(1), F.lit(hold) - F.col("held"))
    asked = at.where(F.col("held") < hold).withColumn("step", F.explode(steps)).withColumn("rn", F.col("rn0") + F.col("step"))
    p = asked.join(numbered, ["symbol", "rn"])
    own = list(dict.fromkeys([*ids, "symbol"]))
    w = Window.partitionBy(*own).orderBy("step")
    before = F.max(F.col("close") * keep).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.select(*own, "entry", "date", (F.col("held") + F.col("step")).alias("held"), F.greatest("stop", before).alias("stop"), "open", "low", "close", "step")
    reason = F.when(F.col("open") <= F.col("stop"), "gap_stop").when(F.col("low") <= F.col("stop"), "stop").when(F.col("held") >= hold, "max_hold")
    p = p.withColumn("reason", reason)
    ended = F.count("reason").over(w.rowsBetween(Window.unboundedPreceding, -1))
    price = F.when(F.col("reason") == "gap_stop", F.col("open")).when(F.col("reason") == "stop", F.col("stop")).otherwise(F.col("close"))
    return p.withColumns({"ended": ended, "price": price}).where("ended = 0").select(*own, "entry", "date", "held", "stop", "price", "reason", "close")


def advance(state: DataFrame, bars: DataFrame, ids: list[str], hold: int, keep: float) -> DataFrame:
    """The state after new bars: ``ids``, ``symbol``, ``entry``, ``stop``, ``held``, ``marked``, ``price``, ``reason``.

    A position that has ended (``reason`` is not null) stays as it is; one without new bars too. To go on day by day or over all days at once gives the same.
    The bars must reach back to the last marked day of every open position.
    """
    own = list(dict.fromkeys([*ids, "symbol"]))
    m = marks(state.where("reason IS NULL"), bars, ids, hold, keep)
    last = m.groupBy(*own).agg(F.max(F.struct("held", "date", F.greatest("stop", F.col("close") * keep).alias("stop"), "price", "reason")).alias("l"))
    new = state.join(last, own, "left")
    take = lambda c, old: F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(old)).alias(old)
    return new.select(*own, "entry", take("stop", "stop"), take("held", "held"), take("date", "marked"), take("price", "price"), take("reason", "reason"))
