"""Shaping and folding of texts for bounded reports."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "\n[... omitted ...]\n"

#: Typographic characters and the plain ones that they count as.
TYPOGRAPHIC = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "…": "...",
}


def head_tail(text: Column, limit: int, head: float) -> Column:
    """A text of more than ``limit`` characters cut to its beginning and end, with a marker between; ``head`` is the beginning's share."""
    first = int(limit * head)
    last = limit - first
    cut = F.concat(F.substring(text, 1, first), F.lit(MARKER), F.right(text, F.lit(last)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def mentions(text: Column, symbol: Column) -> Column:
    """How often ``symbol`` stands in ``text`` as a word of its own, letter case kept; null for a null argument."""
    body = F.replace(text, symbol, F.lit("\x01"))
    return F.when(F.length(symbol) > 0, F.regexp_count(body, F.lit(r"(?<![A-Za-z0-9\x01])\x01(?![A-Za-z0-9\x01])")))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form, plain quotes and dashes, single blanks, no letter case. Null stays null."""
    table = str.maketrans(TYPOGRAPHIC)

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return " ".join(unicodedata.normalize("NFKC", t.translate(table)).casefold().split())

    return text.map(one)


def chunks(text: str, cap: int) -> list[str]:
    """Greedy pieces of a text, each the longest whose JSON form has at most ``cap`` characters; together they are the text."""
    out, at = [], 0
    while at < len(text):
        low, high = 1, min(len(text) - at, cap)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(json.dumps(text[at : at + mid], ensure_ascii=False)) <= cap else (low, mid - 1)
        out.append(text[at : at + low])
        at += low
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunked(text: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else chunks(t, int(c)) for t, c in zip(text, cap)])
