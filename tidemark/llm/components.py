"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node it reaches.

    Each round hangs all neighbours of a node on its smallest one; rounds grow with the logarithm of the
    longest chain. Only two numbers of a round reach the driver. A node's neighbours are never gathered.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = _state(now)
    while True:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(b.alias("a"), F.col("m").alias("b"))
        now = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(b.alias("node"), b.alias("root")).distinct()
    return now.select(a.alias("node"), b.alias("root")).union(roots)
