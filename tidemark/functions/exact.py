"""Functions that need exact arithmetic or a canonical form; Arrow batches, no row-at-a-time calls."""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def share_count(equity: float, entry: float, stop: float, risk: float, cap: float) -> int | None:
    """The lesser of what the risk budget and the cap allow, floored on the exact values of the doubles. None where the
    entry is not positive or the stop is not below it."""
    if any(x is None or x != x or x in (float("inf"), float("-inf")) for x in (equity, entry, stop, risk, cap)) or entry <= 0 or stop >= entry:
        return None
    e = Fraction(equity)
    return max(0, min(e * Fraction(risk) // (Fraction(entry) - Fraction(stop)), e * Fraction(cap) // Fraction(entry)))


@F.pandas_udf(T.LongType())
def shares(equity: pd.Series, entry: pd.Series, stop: pd.Series, risk: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([share_count(*row) for row in zip(equity, entry, stop, risk, cap)], dtype="Int64")


def canonical(text: str | None) -> str | None:
    """A document with sorted members and no blanks; None where it is null or unreadable."""
    try:
        value = text
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return None if text is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form."""
    return text.map(lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest())
