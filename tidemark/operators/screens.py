"""Screens composed of named rules: filters narrow the symbols of a day, signals say what was seen in those left."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``test`` gives a boolean column over the indicators in ``needs`` (name to column over the series); null means that data is missing.
    ``warm_up``: bars that the indicators take."""

    name: str
    needs: dict[str, Callable[[], Column]]
    test: Callable[[], Column]
    warm_up: int = 1


class Registry:
    """Rules by name. A name is given once."""

    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}

    def add(self, rule: Rule) -> Rule:
        if rule.name in self._rules:
            raise ValueError(f"{rule.name} is there already")
        self._rules[rule.name] = rule
        return rule

    def __getitem__(self, name: str) -> Rule:
        if name not in self._rules:
            raise KeyError(f"{name}: not among {sorted(self._rules)}")
        return self._rules[name]

    def names(self) -> list[str]:
        return sorted(self._rules)


@dataclass(frozen=True)
class Strategy:
    """All filters must hold; every signal that holds is a hit."""

    name: str
    filters: tuple[Rule, ...]
    signals: tuple[Rule, ...]

    @property
    def warm_up(self) -> int:
        return max((r.warm_up for r in (*self.filters, *self.signals)), default=1)


def compose(name: str, filters: list[str], signals: list[str], of: Registry, to: Registry) -> Strategy:
    """A strategy from names of registered filters and signals."""
    return Strategy(name, tuple(of[x] for x in filters), tuple(to[x] for x in signals))


def screen(series: DataFrame, strategy: Strategy) -> DataFrame:
    """``series`` with ``state`` (``no_data``, ``filtered``, ``miss`` or ``hit``), ``rejected_by`` (the first filter that doesn't hold, null if all do) and
    ``signals`` (names of those that hold, in order; empty unless all filters hold).

    Semantics: a rule over missing data doesn't hold; ``no_data`` tells it from one that fails. Rows in, rows out; an empty table gives none. The indicators
    of all rules are computed together, each once, so that Catalyst takes one pass per window.
    """
    rules = (*strategy.filters, *strategy.signals)
    needs = {n: f for r in rules for n, f in r.needs.items()}
    t = series.withColumns({f"__{n}": f() for n, f in needs.items()})
    t = t.withColumns({f"__ok_{r.name}": r.test() for r in rules})
    ok = lambda r: F.coalesce(F.col(f"__ok_{r.name}"), F.lit(False))
    first = F.coalesce(*[F.when(~ok(r), F.lit(r.name)) for r in strategy.filters], F.lit(None).cast("string"))
    blank = F.array(*[F.col(f"__ok_{r.name}").isNull() for r in rules])
    hits = F.filter(F.array(*[F.when(ok(r), F.lit(r.name)) for r in strategy.signals]), lambda x: x.isNotNull())
    t = t.withColumn("rejected_by", first)
    t = t.withColumn("signals", F.when(F.col("rejected_by").isNull(), hits).otherwise(F.array().cast("array<string>")))
    state = F.when(F.size("signals") > 0, "hit").when(F.exists(blank, lambda x: x), "no_data").when(F.col("rejected_by").isNotNull(), "filtered").otherwise("miss")
    return t.withColumn("state", state).select(*series.columns, "state", "rejected_by", "signals")


class BarProvider(Protocol):
    """Where bars come from; a day after ``end`` is never given."""

    def bars(self, start: dt.date, end: dt.date) -> DataFrame: ...


class EntryPolicy(Protocol):
    """Turns hits into orders: portfolio, date, symbol, rank."""

    def orders(self, hits: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class FolderBars:
    """Bars of a frame, cut to the asked days before anything else reads them."""

    frame: DataFrame
    day: str = "date"

    def bars(self, start: dt.date, end: dt.date) -> DataFrame:
        return self.frame.where(F.col(self.day).between(F.lit(start), F.lit(end)))


@dataclass(frozen=True)
class FirstSignal:
    """One portfolio per signal, ranked by ``score`` and then by symbol."""

    score: str

    def orders(self, hits: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        t = hits.select(F.explode("signals").alias("portfolio"), "date", "symbol", F.col(self.score).alias("score"))
        w = Window.partitionBy("portfolio", "date").orderBy(F.desc_nulls_last("score"), "symbol")
        return t.withColumn("rank", F.row_number().over(w)).drop("score")


def screened(provider: BarProvider, strategy: Strategy, days: int, clock: Callable[[], dt.date]) -> DataFrame:
    """The screen of the ``days`` calendar days up to the clock's day, over as much history as the strategy's warm-up takes."""
    today = clock()
    back = max(400, 2 * strategy.warm_up)
    t = screen(provider.bars(today - dt.timedelta(days + back), today), strategy)
    return t.where(F.col("date") > F.lit(today - dt.timedelta(days)))
