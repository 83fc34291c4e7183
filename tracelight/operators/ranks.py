"""Ranks and running sums inside large groups, without one task that holds a group.

Rows of a group are dealt to buckets by an expression that rises with their order.  Windows run inside a
bucket; what lies before a bucket is added from a small table with a row for each group and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _running(df: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    dealt = df.withColumn("_bucket", bucket)
    sums = dealt.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumn("_own", F.sum(value).over(inside))
    return own.join(shifts, [*by, "_bucket"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def rank_in_group(df: DataFrame, by: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """The place of each row in its group, from 1; ``order`` must leave no ties, and ``bucket`` must not fall along it."""
    return _running(df, by, bucket, order, F.lit(1), name)


def running_sum(df: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to and with each row of a group."""
    return _running(df, by, bucket, order, value, name)


def fraction(df: DataFrame, by: list[str], bucket: Column, order: list, part: int, whole: int) -> DataFrame:
    """``part`` of every ``whole`` rows of a group by place, one at least and no more than the fraction rounded up."""
    placed = rank_in_group(df, by, bucket, order, "_place")
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    chosen = (F.col("_place") - 1) % whole < part
    # every block of ``whole`` places before this one gave ``part`` rows
    number = F.floor((F.col("_place") - 1) / whole) * part + (F.col("_place") - 1) % whole + 1
    most = F.greatest(F.ceil(F.col("_size") * part / whole), F.lit(1))
    return placed.join(size, by).where(chosen & (number <= most)).drop("_place", "_size")
