"""Semi, mark and left joins. All are equi-joins that Spark can hash, sort or broadcast by measured size."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_fresh = count()


def _keyed(match: DataFrame, column: str) -> DataFrame:
    return match.select(F.col(f"`{column}`").alias(f"__m{next(_fresh)}"))


def semi_join(df: DataFrame, key: Column, match: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in the match; null equals null."""
    name = f"__k{next(_fresh)}"
    right = _keyed(match, column).distinct()  # combined before the shuffle: a small set of keys then turns into a broadcast
    keyed = df.withColumn(name, key)
    return keyed.join(right, keyed[name].eqNullSafe(right[right.columns[0]]), "left_semi").drop(name)


def anti_join(df: DataFrame, key: Column, match: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not in the match; null equals null."""
    name = f"__k{next(_fresh)}"
    right = _keyed(match, column)
    keyed = df.withColumn(name, key)
    return keyed.join(right, keyed[name].eqNullSafe(right[right.columns[0]]), "left_anti").drop(name)


def mark_join(df: DataFrame, key: Column, match: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """``df`` with a boolean column that tells whether the key is in the match, and that column."""
    name, mark = f"__k{next(_fresh)}", f"__in{next(_fresh)}"
    right = _keyed(match, column).distinct()
    own = right.columns[0]
    right = right.withColumn(mark, F.lit(True))
    keyed = df.withColumn(name, key)
    joined = keyed.join(right, keyed[name].eqNullSafe(right[own]), "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))
    return joined.drop(name, own), F.col(mark)


def left_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Every left row with each match, or once with nulls; a null key never matches.

    Null keys of the left side meet in one partition, which adaptive execution splits like any skewed one of an outer join's
    left side; those of the right side are dropped before the shuffle.
    """
    a, b = f"__k{next(_fresh)}", f"__k{next(_fresh)}"
    lk, rk = left.withColumn(a, left_key), right.withColumn(b, right_key)
    rk = rk.filter(rk[b].isNotNull())
    return lk.join(rk, lk[a] == rk[b], "left").drop(a, b)
