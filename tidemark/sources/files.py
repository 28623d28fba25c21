"""Readers and writers of file formats, with pushdown where the format has it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import ship, with_missing_columns


def read_partitioned_bars(
    spark: SparkSession, root: str, schema: T.StructType, start: dt.date | None = None, end: dt.date | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """Bars written by ``sinks.upsert_by_year``. The bounds prune year folders and reach the row groups; nothing
    later than ``as_of`` is read. A folder that does not exist reads as an empty table of the schema."""
    ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    df = spark.read.schema(full).parquet(root)
    last = min([d for d in (end, as_of) if d], default=None)
    if start:
        df = df.where((F.col("year") >= start.year) & (F.col("date") >= F.lit(start)))
    if last:
        df = df.where((F.col("year") <= last.year) & (F.col("date") <= F.lit(last)))
    return df.drop("year")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; lines that do not fit fail the read. Columns beyond the file's are null."""
    head = spark.read.option("header", True).csv(path).columns
    have = T.StructType([schema[c] for c in head if c in schema.names])
    if len(have) != len(head):
        raise ValueError(f"columns that the schema lacks: {[c for c in head if c not in schema.names]}")
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(have).csv(path)
    return with_missing_columns(df, schema).select(*schema.names)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, unreadable lines); an unreadable line never turns into a row of nulls."""
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*"), parsed.where(~F.col("ok")).select("value")


def read_orc(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return with_missing_columns(spark.read.orc(path), schema).select(*schema.names)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database query read in ``parts`` ranges of a numeric column, so that no single connection carries it all."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", f"({query}) q")
        .options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options)
        .load()
    )


def _is_a(plan, kinds: list) -> bool:
    children = plan.children()
    return any(k.isInstance(plan) for k in kinds) or any(_is_a(children.apply(i), kinds) for i in range(children.size()))


def read_only_sql(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """A SELECT over named frames. Statements that would change anything are refused before they run: a plan that is or holds a command
    or a statement that is no query.

    The names stand for the frames while the statement is analysed. Temporary views of the caller that have such a name are put back afterwards.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    load = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    if _is_a(plan, [load(f"{logical}.Command"), load(f"{logical}.ParsedStatement")]):
        raise PermissionError(f"not a query: {plan.getClass().getSimpleName()}")
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {n: spark.table(n) for n in views if n in own}
    for n, df in views.items():
        df.createOrReplaceTempView(n)
    try:
        return spark.sql(text)
    finally:
        for n in views:
            if n in before:
                before[n].createOrReplaceTempView(n)
            else:
                spark.catalog.dropTempView(n)
