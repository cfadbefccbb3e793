"""Edge-set algebra. Undirected graphs hold both directions of an edge and a loop once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div


def reversed_edges(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def dedupe(e: DataFrame) -> DataFrame:
    """One row for each (src, dst); of several weights the smallest."""
    if "weight" in e.columns:
        return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return e.select("src", "dst").distinct()


def drop_loops(e: DataFrame) -> DataFrame:
    return e.where("src <> dst")


def symmetrize(e: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Both directions of every edge, once."""
    return dedupe((e if keep_loops else drop_loops(e)).unionByName(drop_loops(reversed_edges(e))))


def max_id(e: DataFrame) -> DataFrame:
    """n: the number of vertices if it is not stored, the largest id and one."""
    return e.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).cast("long").alias("n"))


def csr(e: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """src, neighbors sorted[, weights in their order], offset into the concatenation. vertices (id): who has a row though isolated.
    Offsets come from a running sum inside ranges of src and the sums of the ranges before; no task sorts all rows."""
    if "weight" in e.columns:
        rows = e.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("_n")).select("src", F.col("_n.dst").alias("neighbors"), F.col("_n.weight").alias("weights"))
    else:
        rows = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
    if vertices is not None:
        rows = vertices.select(F.col("id").alias("src")).join(rows, "src", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("neighbors", "weights") if c in rows.columns})
    return running(rows.withColumn("_size", F.size("neighbors").cast("long")), "src", "_size", "offset").drop("_size")


#: Ids share a block of so many for running sums.
BLOCK = 1 << 16


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before in order. Blocks of ids are summed first, the sums of blocks run
    over by one small window, and each block by its own."""
    blocked = df.withColumn("_block", div(F.col(order), BLOCK))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(sums, "_block").withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
    return out.drop("_block", "_base")


def from_csr(c: DataFrame) -> DataFrame:
    if "weights" in c.columns:
        return c.select("src", F.explode(F.arrays_zip("neighbors", "weights")).alias("_e")).select("src", F.col("_e.neighbors").alias("dst"), F.col("_e.weights").alias("weight"))
    return c.select("src", F.explode("neighbors").alias("dst"))


def owner(v: Column, n: int, parts: int) -> Column:
    """The part that owns vertex v when n ids are cut into consecutive ranges, the first n mod parts of them one longer; -1: none."""
    q, r = divmod(n, parts)
    big = r * (q + 1)
    own = F.when(v < big, div(v, q + 1)).otherwise(r + div(v - big, max(1, q))).cast("int")
    return F.when((v >= 0) & (v < n), own).otherwise(-1)


def balanced_ranges(spark, n: int, parts: int) -> DataFrame:
    q, r = divmod(n, parts)
    p = F.col("id")
    return spark.range(parts).select(p.cast("int").alias("pe"), (p * q + F.least(p, F.lit(r))).cast("long").alias("first"), ((p + 1) * q + F.least(p + 1, F.lit(r))).cast("long").alias("last"))


def round_robin(e: DataFrame, n: int, parts: int) -> DataFrame:
    """Relabels id to the (id div parts)-th vertex of part id mod parts."""
    q, r = divmod(n, parts)
    new = lambda c: (F.pmod(F.col(c), F.lit(parts)) * q + F.least(F.pmod(F.col(c), F.lit(parts)), F.lit(r)) + div(F.col(c), parts)).cast("long").alias(c)
    return e.select(new("src"), new("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def edge_owners(e: DataFrame, n: int, parts: int) -> DataFrame:
    """id, degree, pe: vertices cut so that each part has about m / parts edges, in the order of ids."""
    spark = e.sparkSession
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    rows = spark.range(n).join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    rows = running(rows, "id", "degree", "_before")
    total = rows.agg(F.sum("degree").alias("_m"))
    size = F.greatest(F.lit(1), div(F.col("_m") + parts - 1, parts))
    rows = rows.join(F.broadcast(total))  # one row
    return rows.select("id", "degree", F.greatest(F.lit(0), div(F.col("_before") + F.col("degree") + size - 1, size) - 1).cast("int").alias("pe"))


def edge_balanced_ranges(e: DataFrame, n: int, parts: int) -> DataFrame:
    return edge_owners(e, n, parts).groupBy("pe").agg(F.min("id").alias("first"), (F.max("id") + 1).alias("last"), F.sum("degree").alias("edges"))


def redistribute(e: DataFrame, n: int, parts: int, remap: bool = False, by_edges: bool = False) -> DataFrame:
    """The edge set with the part that owns each tail (pe), each edge once."""
    e = dedupe(round_robin(e, n, parts) if remap else e)
    if not by_edges:
        return e.withColumn("pe", owner(F.col("src"), n, parts))
    return e.join(edge_owners(e, n, parts).select(F.col("id").alias("src"), "pe"), "src")


def relabel(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends through mapping (id, new)."""
    a, b = (mapping.select(F.col("id").alias(c), F.col("new").alias(f"_{c}")) for c in ("src", "dst"))
    return e.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def ranked_permutation(vertices: DataFrame, key: Column) -> DataFrame:
    """(id, new): ids by their rank under key. For small tables; permute() is row-local."""
    return vertices.select("id", (F.row_number().over(Window.orderBy(key, "id")) - 1).cast("long").alias("new"))


def permute(e: DataFrame, n: int, seed: int = 0, columns: tuple[str, ...] = ("src", "dst"), back: bool = False) -> DataFrame:
    """Relabels by a keyed permutation of [0, n), without a shuffle."""
    import pyarrow as pa

    from ..permutation import permuted
    from ..shipping import ship

    ship(e.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permuted(b.column(i).to_numpy(), n, seed, back)) if name in columns else b.column(i) for i, name in enumerate(b.schema.names)], names=b.schema.names)

    return e.mapInArrow(run, e.schema)


def weigh_by_degree(e: DataFrame, vertices: DataFrame, isolated: int = 0) -> DataFrame:
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("weight"))
    return vertices.join(degree, "id", "left").select("id", F.coalesce("weight", F.lit(isolated)).cast("long").alias("weight"))


def drop_weights(e: DataFrame) -> DataFrame:
    return e.drop("weight")


def sorted_edges(e: DataFrame) -> DataFrame:
    return e.orderBy("src", "dst")


def clique_expansion(pins: DataFrame) -> DataFrame:
    """pins (net, vertex, direction: I, O or B): edges between pins of a net whose directions differ or are both B."""
    a, b = (pins.select("net", F.col("vertex").alias(v), F.col("direction").alias(f"d_{v}")) for v in ("src", "dst"))
    return a.join(b, "net").where("src <> dst and (d_src <> d_dst or d_src = 'B')").select("src", "dst")


def distribution(ranges: DataFrame) -> DataFrame:
    """ranges (pe, first, last) with empty parts inheriting the end of the last one before."""
    before = Window.orderBy("pe").rowsBetween(Window.unboundedPreceding, 0)
    return ranges.select("pe", F.coalesce(F.max(F.when(F.col("last") > F.col("first"), F.col("last"))).over(before), F.lit(0)).alias("last"))
