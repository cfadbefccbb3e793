"""Edge and vertex weights in [begin, end). All are functions of a canonical pair or an id, so both directions agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..hashing import bits52

BEGIN, END = 1, 100


def _checked(begin: int, end: int) -> int:
    if begin >= end:
        raise ValueError("begin must be below end")
    return end - begin


def hashed(e: DataFrame, begin: int = BEGIN, end: int = END, family: str = "native") -> DataFrame:
    """From the pair alone, whatever the seed."""
    return e.withColumn("weight", (begin + bits52(0, F.least("src", "dst"), F.greatest("src", "dst"), family=family) % _checked(begin, end)).cast("long"))


def uniform_edges(e: DataFrame, seed: int, begin: int = BEGIN, end: int = END, family: str = "native") -> DataFrame:
    return e.withColumn("weight", (begin + bits52(seed, F.lit("e"), F.least("src", "dst"), F.greatest("src", "dst"), family=family) % _checked(begin, end)).cast("long"))


def uniform_vertices(v: DataFrame, seed: int, begin: int = BEGIN, end: int = END, family: str = "native") -> DataFrame:
    return v.withColumn("weight", (begin + bits52(seed, F.lit("v"), F.col("id"), family=family) % _checked(begin, end)).cast("long"))


def voided(df: DataFrame) -> DataFrame:
    return df.drop("weight")


def weighted_edges(e: DataFrame, kind: str, seed: int = 0, begin: int = BEGIN, end: int = END, family: str = "native") -> DataFrame:
    """By name: default, voiding, hashing_based, uniform_random, euclidean_distance (made by the geometric generators)."""
    return {"default": lambda: e, "euclidean_distance": lambda: e, "voiding": lambda: voided(e), "hashing_based": lambda: hashed(e, begin, end, family), "uniform_random": lambda: uniform_edges(e, seed, begin, end, family)}[kind]()
