"""Uniform numbers as pure functions of a seed and keys, so that a graph does not depend on how it is partitioned.

Two families: "native" (xxhash64, the fast default) and "portable" (MD5, which any SQL engine can repeat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 52


def bits52(seed: int, *keys: Column, family: str = "native") -> Column:
    """A long below 2^52."""
    if family == "portable":
        said = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
        return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *keys), 12)


def uniform(seed: int, *keys: Column, family: str = "native") -> Column:
    """A double in [0, 1)."""
    return bits52(seed, *keys, family=family) / F.lit(float(SPAN))


def sql_bits52(seed: int, *keys: str) -> str:
    """The portable family in DuckDB."""
    said = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5({said}), 1, 13))::BIGINT"


def sql_uniform(seed: int, *keys: str) -> str:
    return f"({sql_bits52(seed, *keys)} / {float(SPAN)!r})"
