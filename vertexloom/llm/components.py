"""Connected components of a distributed table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def components(links: DataFrame) -> DataFrame:
    """links: u, v of one type, any order, loops and repeats allowed. Returns node, root: each node that has a link to
    another and the smallest node it reaches.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest; stars are the fixed point.
    A node's neighbours are reduced by min() before the shuffle and joined back, never collected; what a hub has is split by
    Spark's skewed joins. Every round is written as a table and the last one's goes. The rounds grow with the logarithm of the longest
    path; they end, as each that changes a tie lowers it. Nulls link nothing. An empty table gives none."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "ties")
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        after = stored(tied.distinct(), "ties")
        removed(large, edges)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
