"""Assertions that joins and merges rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, raising at run time if a key stands twice.

    A window by the keys counts them where the rows already are for the join that follows, so no job runs ahead.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = df.withColumn("__n", n)
    ok = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{what} is not unique by {', '.join(keys)}")).cast("boolean")).otherwise(True)
    return marked.filter(ok).drop("__n")


def assert_none(df: DataFrame, condition, message: str) -> DataFrame:
    """``df``, raising at run time if a row meets the condition."""
    return df.filter(F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
