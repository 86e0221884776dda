"""Percentiles of very large numeric columns from mergeable sketches (problem 1).

Values are counted in signed logarithmic buckets: bucket i holds the magnitudes in (g^(i-1), g^i] with g = (1+a)/(1-a), so the
bucket's middle 2*g^i/(g+1) is within the relative error a of every value in it. A sketch is a table (group..., bucket, n); sketches
of partitions or days merge by adding the counts of equal buckets. All steps are built-in expressions: the partial count happens
before the exchange, so a group with a third of all rows sends no more rows than it has buckets.

Defined cases. Null, NaN and infinite values aren't counted. Magnitudes under `smallest` count as zero (absolute error `smallest`).
A null group value is a group of its own. The percentile p of n values is the value of rank floor(p*(n-1)) (0-based), so the
answer is within a of a value that occurs; equal values and repeated rows count each time. A group without values, or an empty
table, has no row. Columns of other names, also ones named like the results, don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALLEST = 1e-9


def growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float, smallest: float = SMALLEST) -> Column:
    """Signed, order-keeping bucket number: 0 for zero; positive values from 1 up; negative ones from -1 down."""
    log_g = math.log(growth(error))
    first = math.ceil(math.log(smallest) / log_g) - 1
    i = F.ceil(F.ln(F.abs(value)) / F.lit(log_g)) - F.lit(first)
    return F.when(F.abs(value) < smallest, F.lit(0)).otherwise(F.signum(value).cast("long") * F.greatest(i, F.lit(1))).cast("int")


def middle_of(bucket: Column, error: float, smallest: float = SMALLEST) -> Column:
    """The value that stands for all values of a bucket."""
    g = growth(error)
    first = math.ceil(math.log(smallest) / math.log(g)) - 1
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * F.lit(2 / (g + 1)) * F.exp((F.abs(bucket) + F.lit(first)) * F.lit(math.log(g))))


def sketch(df: DataFrame, value: str, by: list[str], error: float = 0.01) -> DataFrame:
    """(by..., bucket, n)."""
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(usable).groupBy(*[F.col(c) for c in by], bucket_of(v, error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sum of sketches, also over fewer group columns than they have: (by..., bucket, n)."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], points: dict[str, float], error: float = 0.01) -> DataFrame:
    """(by..., n, one column a point). The window holds one row a bucket, a number that the value range bounds."""
    up_to = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*by)
    s = sketches.select(*by, "bucket", F.sum("n").over(up_to).alias("__upto"), F.sum("n").over(total).alias("__n"))
    picks = [F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * (F.col("__n") - 1)), F.col("bucket"))).alias(name) for name, p in points.items()]
    return s.groupBy(*by).agg(F.max("__n").alias("n"), *picks).select(*by, "n", *[middle_of(F.col(x), error).alias(x) for x in points])
