"""Declared schemas: tables are never inferred where they are written or read from text formats."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_DAY, _TS = T.DateType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BARS = _schema(symbol=_S, date=_DAY, open=_D, high=_D, low=_D, close=_D, volume=_L, provider=_S, fetched_at=_TS)
MEMBERSHIP = _schema(snapshot_date=_DAY, symbol=_S, source_symbol=_S, company_name=_S, gics_sector=_S, source=_S)
FUNDAMENTALS = _schema(
    accession_no=_S, symbol=_S, form=_S, fiscal_period_end=_DAY, filed_at=_TS, revenue=_D, net_income=_D, fcf=_D,
    equity=_D, assets=_D, shares=_D, source_url=_S, fetched_at=_TS,
)
SIGNALS = _schema(run_date=_DAY, symbol=_S, strategy_key=_S, signal_name=_S, strength=_D, metrics_json=_S)
RUNS = _schema(
    run_id=_S, run_date=_DAY, mode=_S, config_hash=_S, metadata_json=_S, status=_S, started_at=_TS, completed_at=_TS,
    report_path=_S, error_summary=_S,
)
VERDICTS = _schema(
    run_id=_S, symbol=_S, as_of=_DAY, strategy_key=_S, recommendation=_S, reasons_json=_S, no_trade=_B,
    news_supply_collected_items=_I, news_supply_exported_items=_I, news_supply_symbol_mention_items=_I, news_supply_level=_S,
)
EVENTS = _schema(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)
