"""Connected components on tables of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, release, spread_join


def _sign(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """(u long, v long) links in, (node, root) out: one row per node that has a link, root being its component's least node.

    Every step is a distributed aggregation and a join; the tables of all rounds are written to the shared folder.
    A star's centre may have any number of neighbours: their minimum and number are combined before the shuffle, and
    the centres of the largest stars, of which there are few, reach their edges by a broadcast (``spread_join``).
    """
    # Least neighbour first: edges are kept as (larger u, smaller v).
    edges = materialise(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    sign = _sign(edges)
    while sign[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degree = F.count(F.lit(1)).alias("n")
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("u", "m").alias("m"), "n"), "star-centres")
        # Large star: every larger neighbour v of u is linked to the least node around u.
        wide = spread_join(both.filter("v > u"), least, "u", "n", 2 * sign[0])
        large = materialise(wide.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: u and its smaller neighbours are linked to the least of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), degree), "star-centres")
        near = spread_join(large, low, "u", "n", large.count())
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = materialise(small.distinct(), "small-star")
        new_sign = _sign(new)
        for done in (least, low, large, edges):
            release(done)
        edges = new
        if new_sign == sign:
            break
        sign = new_sign
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
