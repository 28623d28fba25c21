"""Queries of the training-text problems 6 to 9, and their SQL twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_string
from ..sources.tables import table
from . import bpe, leakage, mojibake, topn

#: Folder of the public tokenizers' files on driver and executors.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def p6_ranked(spark: SparkSession, root: str) -> DataFrame:
    """The best five of every (run date, strategy) with their strength and rank."""
    s = table(spark, root, "signals", ["run_date", "strategy_key", "symbol", "signal_name", "strength"])
    best = topn.top_n_per_group(s, ["run_date", "strategy_key"], ["symbol", "signal_name"], "strength", 5)
    return best.select(
        day_string(F.col("run_date")).alias("run_day"), "strategy_key", "symbol", "signal_name", "strength", "rank"
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_ranked(spark, root).select("run_day", "strategy_key", "symbol", "signal_name")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", ["doc_id", "text"])
    return bpe.encode_corpus(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", ["doc_id", "text"])
    items = table(spark, root, "eval_items", ["item_id", "item_text"])
    return leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "item_text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p8_matches(spark: SparkSession, root: str) -> DataFrame:
    """Leaks with the longest verbatim match, its place and the part of the item."""
    return _leaks(spark, root).withColumn("share", F.round("share", 4))


def p8_clean(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the documents that stay when the affected ones are removed."""
    docs = table(spark, root, "documents", ["doc_id"])
    return leakage.without_leaks(docs, "doc_id", _leaks(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", ["doc_id", "text"])
    return mojibake.garbled_texts(docs, "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, root: str) -> DataFrame:
    """Garbled documents with their text restored where it can be."""
    docs = table(spark, root, "documents", ["doc_id", "text"])
    return mojibake.garbled_texts(docs, "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found,
    "p6_ranked": p6_ranked,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_BEST = """i AS (
 SELECT run_date, strategy_key, symbol, signal_name, max(strength) AS strength FROM signals
 WHERE strength IS NOT NULL AND NOT isnan(strength) AND NOT isinf(strength) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY run_date, strategy_key ORDER BY strength DESC, symbol, signal_name) AS rank FROM i)"""

#: Problems 7 to 9 can't be said in SQL: they are tested against a reference encoder, brute force and round trips.
SQL: dict[str, str] = {
    "p6_found": f"WITH {_BEST} SELECT strftime(run_date, '%Y-%m-%d') AS run_day, strategy_key, symbol, signal_name FROM r WHERE rank <= 5",
    "p6_ranked": f"WITH {_BEST} SELECT strftime(run_date, '%Y-%m-%d') AS run_day, strategy_key, symbol, signal_name, strength, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
}
