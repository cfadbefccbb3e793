"""Exact deduplication: groups by a 128-bit content hash, then compares bytes inside the groups.

The hash is the MD5 of the case-folded text, so texts that are equal after lower-casing A-Z always share it. Rows
whose hash is alone are done. The others are grouped by hash *and* by the normalised text itself, which compares
their bytes; partial aggregation leaves one row for each text and map task, so a group that holds a third of all
rows does not meet in one task.

Defined results: a null text counts as empty. A null id is below every other and is kept where all ids of the group
are null. Rows that repeat the kept id are the same document and are all marked kept. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty


def content_hash(text: Column) -> Column:
    return F.md5(F.lower(text))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """A row for each row of df: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    keep: which id of a group stays, "smallest" or "largest". hashed: must be equal for texts equal but for the
    case of A-Z; collisions cost time, never a wrong group."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = text_or_empty(text_col)
    keyed = df.select(F.col(id_col), hashed(text).alias("_key"), text.alias("_text"))
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    norm = ascii_lower(F.col("_text")).alias("_norm")
    same = keyed.join(shared, "_key", "left_semi").select(id_col, "_key", norm).groupBy("_key", "_norm").agg(pick(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = same.select("_key", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size").withColumn("_met", F.lit(True))
    rows = keyed.select(F.col(id_col), "_key", F.sha2(ascii_lower(F.col("_text")), 256).alias("text_sha256"))
    out = rows.join(same, ["_key", "text_sha256"], "left")
    keep_id = F.when(F.col("_met"), F.col("keep_id")).otherwise(F.col(id_col))
    return out.select(F.col(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep_id).alias("kept"), "text_sha256")
