"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of the mix are blocks of equal size. Blocks go to the sources by the highest quotients target / (2 k + 1),
then those of each source to its shards the same way, which gives every shard an integer quota. A shard's documents,
in a seeded order, form a ring of words; its quota is taken from a seeded block on, around the ring as often as
needed. So a shard gives exactly its quota, and each document gives whole copies and at most two parts.

Sources of any size are dealt to shards by a seeded hash of the id; a shard is sorted in one task, a source never is.

Defined results: null texts have size 0; a null source is a source, last in order; rows with equal ids lie side by
side in the ring; a source of size 0 has target 0. An empty table gives none. Extra columns are carried along, but
for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, text_or_empty

BLOCK_WORDS, SHARD_ROWS, MAX_SHARDS, MAX_REPEATS, SEED = 16, 4096, 4096, 3, 17
RESULTS = ["size", "source_size", "target", "taken", "copies", "parts"]


def sainte_lague(df: DataFrame, weight: str, seats: str, key: str, by: list[str]) -> DataFrame:
    """df with quota: seats (equal in a group of by) dealt to its rows by the highest quotients weight / (2 k + 1), ties
    to the smaller key (unique in a group). With D for the mean weight of a seat, a row's share lies between its weight divided by D's
    bounds for rounding; only the seats between those two counts are listed, a few for each row, and ranked."""
    w = Window.partitionBy(*by)
    df = df.withColumn("_all", F.sum(weight).over(w).cast("double")).withColumn("_m", F.count(F.lit(1)).over(w))
    t, all_, half = F.col(weight).cast("double"), F.col("_all"), F.col("_m") / 2
    share = lambda n: F.when((all_ > 0) & (n > 0), F.floor(t * n / all_ + 0.5)).otherwise(0).cast("long")
    df = df.withColumn("_base", F.greatest(share(F.col(seats) - half) - 1, F.lit(0))).withColumn("_top", F.when(t > 0, share(F.col(seats) + half) + 1).otherwise(0))
    df = df.withColumn("_left", F.col(seats) - F.sum("_base").over(w))
    same = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in [*by, key]]
    listed = df.where("_top > _base").select(*by, key, "_left", F.explode(F.sequence("_base", F.col("_top") - 1)).alias("_k"), t.alias("_t"))
    ranked = listed.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.col("_t") / (2 * F.col("_k") + 1)), F.col(key).asc_nulls_last(), "_k")))
    won = ranked.where("_rank <= _left").groupBy(*by, key).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select("_won", *[F.col(c).alias(f"_q_{c}") for c in [*by, key]])
    out = df.join(won, _all(same), "left")
    return out.withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_all", "_m", "_base", "_top", "_left", "_won", *[f"_q_{c}" for c in [*by, key]])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def source_targets(sources: DataFrame, weight: Column, total: Column | None = None, most: int = MAX_REPEATS) -> DataFrame:
    """sources (source, source_size) with target: shares of the total by weight, held to most times the source's size,
    the excess reshared by weight until none is above. With the sources by ascending cap per weight, the level of
    those below their caps is the highest of what is left per weight left."""
    every, order = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    df = df.withColumn("_all", F.sum("source_size").over(every) if total is None else total)
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    free = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    df = df.withColumn("_level", left / free).withColumn("_level", F.max("_level").over(every))
    return df.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_all", "_level")


def seeded(seed: int, *cols: Column) -> Column:
    """A number below 2^52 from a seed and values; the same in any SQL engine that has md5."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """df's rows with size, source_size, target, taken, copies (whole ones) and parts, an array of (first, past): ranges
    of words taken besides. Sources weigh 1, 2, 3, repeating, in the order of their names."""
    df = df.drop(*[c for c in df.columns if c in RESULTS])
    source = F.col(source_col)
    df = df.withColumn("size", n_words(text_or_empty(text_col))).withColumn("_hash", seeded(seed, F.col(id_col)))
    sources = df.groupBy(source.alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = source_targets(sources.withColumn("_rank", rank), F.pmod(F.col("_rank") - 1, F.lit(3)) + 1)
    sources = sources.withColumn("_blocks", F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long"))
    sources = sainte_lague(sources, "target", "_blocks", "source", []).withColumnRenamed("quota", "_quota")
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target", "_quota", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("_rows") / SHARD_ROWS)).cast("long").alias("_n"))
    rows = df.join(sources, source.eqNullSafe(F.col("_source"))).withColumn("_shard", F.pmod("_hash", F.col("_n")))
    shards = rows.groupBy("_source", "_shard", "_quota").agg(F.sum("size").alias("_ring"))
    shards = sainte_lague(shards, "_ring", "_quota", "_shard", ["_source", "_quota"]).select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_ring", F.col("quota").alias("_own"))
    rows = rows.join(shards, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).drop("_s", "_h")
    ring = Window.partitionBy("_source", "_shard").orderBy("_hash", F.col(id_col).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum("size").over(ring)).withColumn("_from", F.col("_to") - F.col("size"))
    words = F.least(F.col("_own") * block, MAX_REPEATS * F.col("_ring"))
    rows = rows.withColumn("_words", words)
    rows = rows.withColumn("copies", F.when(F.col("_ring") > 0, F.floor(F.col("_words") / F.greatest(F.col("_ring"), F.lit(1)))).otherwise(0).cast("long"))
    rest = F.col("_words") - F.col("copies") * F.col("_ring")
    start = F.pmod(seeded(seed + 1, F.col("_source"), F.col("_shard")), F.greatest(F.ceil(F.col("_ring") / block), F.lit(1))) * block
    rows = rows.withColumn("_rest", rest).withColumn("_start", F.when(F.col("_ring") > 0, start).otherwise(0))
    past = F.col("_start") + F.col("_rest")
    part = lambda a, b: F.struct((F.greatest(F.col("_from"), a) - F.col("_from")).cast("long").alias("first"), (F.least(F.col("_to"), b) - F.col("_from")).cast("long").alias("past"))
    parts = F.filter(F.array(part(F.lit(0), past - F.col("_ring")), part(F.col("_start"), past)), lambda x: x["past"] > x["first"])
    rows = rows.withColumn("parts", parts).withColumn("taken", F.col("copies") * F.col("size") + F.reduce("parts", F.lit(0).cast("long"), lambda a, x: a + x["past"] - x["first"]))
    return rows.select(*[c for c in df.columns if c not in ("size", "_hash")], *RESULTS)


def materialised(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of the mix: as many rows for each as it has copies, and one for each part, whose text is that run of words
    with single spaces between. Ids repeat."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = mixed.withColumn("_take", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("copies")), lambda i: F.when(i > 0, F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("past")))), F.col("parts"))))
    whole = (F.col("_take.first") == 0) & (F.col("_take.past") == F.col("size"))
    part = F.array_join(F.slice(words, (F.col("_take.first") + 1).cast("int"), (F.col("_take.past") - F.col("_take.first")).cast("int")), " ")
    return rows.where("_take is not null").withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part)).drop("_take", *RESULTS)
