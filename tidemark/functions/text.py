"""Column functions on text that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spelling_key(c: Column) -> Column:
    """Text without the differences of letter case and of leading, trailing or
    repeated blanks. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s 　]+", " ")))


def blank_to_null(c: Column) -> Column:
    """Null where the text is empty or holds white space only."""
    return F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", c)


def day_string(c: Column) -> Column:
    """``yyyy-MM-dd`` of a date."""
    return F.date_format(c, "yyyy-MM-dd")
