"""Checks that give their violations; an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), detail.cast("string").alias("detail"))


def not_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    d = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _found(d, name, F.concat_ws("|", *keys))


def is_null(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    return _found(df.where(F.col(column).isNull()), name, F.col(key))


def not_accepted(df: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    return _found(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).select(column).distinct(), name, F.col(column))


def no_parent(df: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    p = parent.select(F.col(parent_column).alias(column)).distinct()
    return _found(df.where(F.col(column).isNotNull()).select(column).distinct().join(p, column, "left_anti"), name, F.col(column))


def violates(df: DataFrame, condition: Column, key: str, name: str) -> DataFrame:
    """Rows for which the condition that should hold is false."""
    return _found(df.where(~condition), name, F.col(key))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows; refusing to replace data by nothing")
    return df


def same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts, and whether they agree."""
    n = a.agg(F.count("*").alias("source_rows")).crossJoin(F.broadcast(b.agg(F.count("*").alias("sink_rows"))))
    return n.withColumn("equal", F.col("source_rows") == F.col("sink_rows"))


def freshness(df: DataFrame, at: str, now: Column, warn_days: int = 2) -> DataFrame:
    return df.agg(F.max(at).alias("newest")).withColumn("stale", F.coalesce(F.col("newest") < now - F.expr(f"INTERVAL {warn_days} DAYS"), F.lit(True)))
