"""Checks. Each returns the rows that break a rule; report() counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def loops(e: DataFrame) -> DataFrame:
    return e.where("src = dst")


def duplicates(e: DataFrame) -> DataFrame:
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def missing_reverse(e: DataFrame) -> DataFrame:
    """Edges without one of the opposite direction and equal weight."""
    keys = ["src", "dst", *[c for c in ("weight",) if c in e.columns]]
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keys[2:])
    return e.select(*keys).join(back, keys, "left_anti")


def outside(e: DataFrame, n: int) -> DataFrame:
    return e.where((F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n))


def broken_ranges(ranges: DataFrame) -> DataFrame:
    """Parts whose range is not well formed or does not begin where the one before ends (the first: at 0)."""
    before = F.coalesce(F.lag("last").over(Window.orderBy("pe")), F.lit(0))
    return ranges.withColumn("expected", before.cast("long")).where("first > last or first <> expected")


def report(e: DataFrame, n: int, directed: bool = False, allow_loops: bool = False, allow_multi: bool = False) -> DataFrame:
    """rule, broken: a row for each rule that applies. A graph is valid if all are 0."""
    rules = {"outside": outside(e, n)}
    if not allow_loops:
        rules["loops"] = loops(e)
    if not allow_multi:
        rules["duplicates"] = duplicates(e)
    if not directed:
        rules["missing_reverse"] = missing_reverse(e)
    if "weight" in e.columns:
        rules["null_weight"], rules["negative_weight"] = e.where("weight is null"), e.where("weight < 0")
    rules["beyond_32_bits"] = e.where((F.col("src") >= 1 << 32) | (F.col("dst") >= 1 << 32))
    return reduce(DataFrame.unionAll, [df.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("broken")) for k, df in rules.items()])


def is_valid(e: DataFrame, n: int, **options: bool) -> bool:
    return report(e, n, **options).where("rule <> 'beyond_32_bits' and broken > 0").isEmpty()
