"""Sort, limit and sorted merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, keys: list[Column], descending: bool) -> DataFrame:
    """One direction for all keys; nulls first ascending, last descending. With a limit above, Spark keeps a heap per task."""
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def merge_sorted(left: DataFrame, right: DataFrame, keys: list[Column], descending: bool) -> DataFrame:
    """Both inputs by key; of equal keys the right input's rows come first ascending, the left's descending."""
    side = "__side"
    both = left.withColumn(side, F.lit(1)).unionByName(right.withColumn(side, F.lit(0)))
    return sort(both, [*keys, F.col(side)], descending).drop(side)
