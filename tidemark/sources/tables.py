"""Readers of the table directory (one Parquet table per name)."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application. Every operator that runs Python does so."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    archive = shutil.make_archive(f"{folder}/{_PACKAGE.name}", "zip", _PACKAGE.parent, _PACKAGE.name)
    sc.addPyFile(archive)
    sc._tidemark_shipped = True


def table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read ``<root>/<name>.parquet``. Only ``columns`` are read when given. Days are UTC days, so the session's time
    zone is set to it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks as typed nulls, keep the rest as it is.

    Serves the additive schema rule: a reader of an old file sees a new column as null.
    """
    have = set(df.columns)
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
    )
