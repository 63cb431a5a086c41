"""Aggregates as Spark columns; all but SUM of strings combine before the shuffle. PERCENTILE is an operator of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..bind.types import INTEGER, STRING, Expr

#: Arrival order, for the one aggregate that depends on it.
ORDINAL = "__ordinal"


def needs_order(e: Expr) -> bool:
    return e.data[0] == "sum" and e.type == STRING


def aggregate(e: Expr, arg: Column | None) -> Column:
    kind = e.data[0]
    if kind == "count_all":
        return F.count(F.lit(1))
    if kind == "count":
        return F.count(arg)
    if kind == "min":
        return F.min(arg)
    if kind == "max":
        return F.max(arg)
    return _sum(e, arg)


def _sum(e: Expr, x: Column) -> Column:
    """Over nothing: 0 or ''; an overflow is null."""
    if e.type == STRING:
        rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(F.col(ORDINAL).alias("o"), x.alias("x")))))
        return F.array_join(F.transform(rows, lambda r: r["x"]), "")
    if e.type == INTEGER:
        return F.when(F.count(x) == 0, F.lit(0).cast("bigint")).otherwise(F.try_sum(x))
    total = F.coalesce(F.sum(x), F.lit(0.0))
    return total if e.wide else total.cast("float")
