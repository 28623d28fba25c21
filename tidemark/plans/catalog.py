"""All named queries of the core, with their SQL twins.

Days and times come out as strings in both forms, so that results compare the same whatever library reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus_core, daily, derived, ledger, selection, texts, tracking

#: Columns of days (or, for ``window_start``, times) in the results of queries with SQL twins.
DAYS: dict[str, tuple[str, ...]] = {
    "bars_scan": ("date",),
    "bars_asof": ("date",),
    "bars_earliest_latest": ("first_date", "last_date"),
    "backfill_due": ("first_date",),
    "non_finite_rows": ("date",),
    "bars_upsert_keep_last": ("date",),
    "sma_50_200": ("date",),
    "trailing_volume_20": ("date",),
    "returns_ladder": ("date",),
    "high_low_252": ("date",),
    "rising_streak_sma20": ("date",),
    "recovery_after_fall": ("date",),
    "distribution_days": ("date",),
    "trend_episodes": ("first_date", "last_date"),
    "forward_outcomes": ("date",),
    "percentile_ties": ("date",),
    "relative_strength": ("date",),
    "relative_strength_monthly": ("date",),
    "wilder_rsi14": ("date",),
    "wilder_atr14": ("date",),
    "ema_seeded_21": ("date",),
    "equal_weight_basket": ("date",),
    "trailing_stop": ("date",),
    "first_rejection": ("date",),
    "ranked_screen": ("date",),
    "session_lookup": ("date", "five_back", "twenty_on"),
    "fundamentals_asof": ("fiscal_period_end",),
    "fundamentals_latest": ("fiscal_period_end",),
    "filing_latest": ("last_filed",),
    "filing_first_per_period": ("fiscal_period_end", "first_filed"),
    "reporting_gap_projection": ("last_filed", "next_expected"),
    "membership_latest_asof": ("snapshot_date",),
    "symbol_sector_asof": ("snapshot_date",),
    "verdict_scorecard": ("as_of",),
    "runs_without_verdicts": ("run_date",),
    "newest_sessions_semi": ("run_date",),
    "prior_verdicts_topn": ("as_of", "prior_1", "prior_2", "prior_3"),
    "run_configs": ("run_date", "first_seen_run_date"),
    "list_runs": ("run_date",),
    "latest_run_per_date": ("run_date",),
    "drop_contested_runs": ("run_date",),
    "signal_min_max_argmin": ("run_date",),
    "sector_counts": ("snapshot_date",),
    "control_group_union": ("day",),
    "events_windowed": ("window_start",),
}
_MODULES = (corpus_core, daily, ledger, derived, texts, tracking, selection)


def _pattern(column: str) -> tuple[str, str]:
    return ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S") if column == "window_start" else ("yyyy-MM-dd", "%Y-%m-%d")


def _plain(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return query(spark, root).withColumns({c: F.date_format(c, _pattern(c)[0]) for c in DAYS[name]})

    run.__name__, run.__doc__ = name, query.__doc__
    return run


def _plain_sql(name: str, sql: str) -> str:
    days = ", ".join(f"strftime({c}, '{_pattern(c)[1]}') AS {c}" for c in DAYS[name])
    return f"SELECT * REPLACE ({days}) FROM ({sql})"


QUERIES = {n: _plain(n, q) if n in DAYS else q for m in _MODULES for n, q in m.QUERIES.items()}
SQL = {n: _plain_sql(n, s) if n in DAYS else s for m in _MODULES for n, s in m.SQL.items()}
