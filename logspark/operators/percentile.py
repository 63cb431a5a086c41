"""Exact percentiles without gathering a group's values.

Equal values are counted first, which combines before the shuffle; a window then runs through the distinct values of a
group in order. The window sorts and spills like any other sort, so a group of any size only takes time. The one group of
a program without keys is parted at approximate quantiles of its numbers, and windows run through the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bind.types import FLOATING, INTEGER

ONE = "__one"


def _text(x: Column, type_: str) -> Column:
    """Six significant digits for floats, without trailing zeros or a point that nothing follows."""
    if type_ != FLOATING:
        return x.cast("string")
    d = x.cast("double")
    exponent = F.floor(F.log10(F.abs(d)))
    scale = F.pow(F.lit(10.0), F.lit(5.0) - exponent)
    rounded = F.when(d == 0, F.lit(0.0)).otherwise(F.rint(d * scale) / scale)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.format_string("%.5e", d), r"(?:\.0+|(\.[0-9]*?)0+)e", "$1e")
    return F.when((d == 0) | ((F.abs(d) >= 1e-4) & (F.abs(rounded) < 1e6)), fixed).otherwise(science)


def percentiles(df: DataFrame, keys: list[str], value: Column, type_: str, shares: tuple[float, ...], name: str) -> DataFrame:
    """(keys, name): ``[a,b]``, for each share p of a group's n values the one at index min(n - 1, floor(n * p)) in order, in 32-bit arithmetic; nulls don't count."""
    by = [F.col(f"`{k}`") for k in keys]
    counts = df.select(*by, value.alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if keys == [ONE] and type_ in (INTEGER, FLOATING):
        placed = _parted(counts)
    else:
        group = Window.partitionBy(*by)
        upto = group.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("__end", F.sum("__c").over(upto)).withColumn("__n", F.sum("__c").over(group))

    def pick(p: float) -> Column:
        at = F.least(F.col("__n") - 1, F.floor(F.col("__n").cast("float") * F.lit(p).cast("float")))
        return F.max(F.when((F.col("__end") > at) & (F.col("__end") - F.col("__c") <= at), F.col("__v")))

    picked = placed.groupBy(*by).agg(*[pick(p).alias(f"__p{i}") for i, p in enumerate(shares)])
    parts = F.concat_ws(",", *[_text(F.col(f"__p{i}"), type_) for i in range(len(shares))])
    return picked.select(*by, F.concat(F.lit("["), parts, F.lit("]")).alias(name))


#: Parts of a single group; their edges only decide which task counts a value.
PARTS = 64


def _parted(counts: DataFrame) -> DataFrame:
    """``counts`` of one group with __end and __n: sums of the parts before a value's own (at most PARTS rows), and a window in each part."""
    edges = counts.agg(F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], F.lit(1000))).first()[0] or []
    below = sum((F.when(F.col("__v") > F.lit(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    dealt = counts.withColumn("__part", below)
    sums = dealt.groupBy("__part").agg(F.sum("__c").alias("__c"))
    every = Window.partitionBy(F.lit(1))
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(every).alias("__n"))
    own = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("__upto", F.sum("__c").over(own)).join(F.broadcast(sums), "__part").withColumn("__end", F.col("__before") + F.col("__upto"))


def attach(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``more`` beside ``df`` by its keys; null keys equal each other."""
    other = more.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = df[f"`{keys[0]}`"].eqNullSafe(other[f"`{keys[0]}__r`"])
    for k in keys[1:]:
        on = on & df[f"`{k}`"].eqNullSafe(other[f"`{k}__r`"])
    return df.join(other, on, "left").drop(*[f"{k}__r" for k in keys])
