"""Statistics. n counts isolated vertices; rounded values keep six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bit_length
from .transforms import owner


def degrees(e: DataFrame, n: int | None = None) -> DataFrame:
    """id, degree (out-degree); with n, of every id below it."""
    d = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return d if n is None else e.sparkSession.range(n).join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_bins(e: DataFrame, n: int | None = None) -> DataFrame:
    """Bin 0 for degree 0, else floor(log2 degree) + 1."""
    return degrees(e, n).groupBy(bit_length(F.col("degree")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("vertices"))


def degree_stats(e: DataFrame, n: int | None = None) -> DataFrame:
    return degrees(e, n).agg(F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))


def totals(e: DataFrame, n: int) -> DataFrame:
    m = F.count(F.lit(1))
    return e.agg(F.lit(n).cast("long").alias("n"), m.alias("m"), F.round(m / F.lit(float(n)) / F.lit(float(max(1, n - 1))), 12).alias("density"))


def part_stats(e: DataFrame, n: int, parts: int) -> DataFrame:
    """Edges for each part of balanced ranges: min, mean, max, population deviation and imbalance (max / mean)."""
    own = e.groupBy(owner(F.col("src"), n, parts).alias("pe")).agg(F.count(F.lit(1)).alias("m"))
    own = e.sparkSession.range(parts).select(F.col("id").cast("int").alias("pe")).join(own, "pe", "left").select(F.coalesce("m", F.lit(0)).alias("m"))
    return own.agg(F.min("m").alias("min_m"), F.round(F.avg("m"), 6).alias("avg_m"), F.max("m").alias("max_m"), F.round(F.stddev_pop("m"), 6).alias("sd_m"), F.round(F.max("m") / F.avg("m"), 6).alias("imbalance"))


def locality(e: DataFrame, n: int, parts: int) -> DataFrame:
    """Share of edges whose ends have one owner."""
    same = owner(F.col("src"), n, parts) == owner(F.col("dst"), n, parts)
    return e.agg(F.round(F.sum(F.when(same, 1).otherwise(0)) / F.count(F.lit(1)), 6).alias("locality"))


def ghosts(e: DataFrame, n: int, parts: int) -> DataFrame:
    """Distinct heads that a part has from others, summed over parts, and their share of n and them."""
    cut = e.select(owner(F.col("src"), n, parts).alias("pe"), "dst").where(owner(F.col("dst"), n, parts) != F.col("pe")).distinct()
    g = F.count(F.lit(1))
    return cut.agg(g.alias("ghosts"), F.round(g / (g + F.lit(float(n))), 6).alias("fraction"))


def graph_stats(e: DataFrame, n: int, chosen: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """A row: n, m, degree statistics, how many vertices have each chosen degree."""
    d, k = degrees(e, n), F.col("degree")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("degree").cast("long").alias("m"), F.min(k).alias("min_degree"), F.round(F.avg(k), 6).alias("avg_degree"), F.max(k).alias("max_degree"), *[F.sum(F.when(k == c, 1).otherwise(0)).cast("long").alias(f"degree_{c}") for c in chosen], F.lit(int("weight" in e.columns)).alias("weighted"))


def total_weight(e: DataFrame) -> DataFrame:
    return e.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("total_weight"))
