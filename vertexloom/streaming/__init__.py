"""Bounded streams of a graph: chunks of consecutive vertices, as micro-batches of a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.transforms import owner


def spool(g: Graph, folder: str, chunks: int) -> None:
    """Writes the edges by the chunk that owns their tail, sorted; a chunk is a file, and a stream reads it as a batch."""
    chunk = owner(F.col("src"), g.n, chunks)
    e = g.edges.withColumn("chunk", chunk)
    e.repartitionByRange(chunks, "chunk").sortWithinPartitions("chunk", "src", "dst").write.mode("overwrite").partitionBy("chunk").parquet(folder)


def stream(spark: SparkSession, folder: str, schema: str = "src long, dst long") -> DataFrame:
    """An edge stream over a spooled graph, a file for each trigger."""
    return spark.readStream.schema(schema + ", chunk int").option("maxFilesPerTrigger", 1).parquet(folder)


def ordered(e: DataFrame) -> DataFrame:
    """Each undirected edge once, from its larger end."""
    return e.where("dst < src")


def for_each_edge(spark: SparkSession, folder: str, consume: Callable[[DataFrame, int], None], checkpoint: str, only_ordered: bool = False) -> None:
    """Runs consume on each chunk's distinct edges until the stream is through."""
    edges = ordered(stream(spark, folder)) if only_ordered else stream(spark, folder)
    q = edges.writeStream.foreachBatch(lambda df, i: consume(df.select("src", "dst").distinct(), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def for_each_node(spark: SparkSession, folder: str, consume: Callable[[DataFrame, int], None], checkpoint: str, n: int | None = None, chunks: int = 1) -> None:
    """Runs consume on (src, neighbors) of each chunk. With n and the number of chunks that spool() was given, vertices without edges
    have a row too, those of chunks without edges after the stream."""
    seen: set[int] = set()

    def vertices(chunk: int) -> DataFrame:
        q, r = divmod(n, chunks)
        return spark.range(chunk * q + min(chunk, r), (chunk + 1) * q + min(chunk + 1, r)).withColumnRenamed("id", "src")

    def lists(df: DataFrame) -> DataFrame:
        return df.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))

    def whole(own: DataFrame, chunk: int) -> DataFrame:
        return vertices(chunk).join(own, "src", "left").select("src", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))

    def batch(df: DataFrame, i: int) -> None:
        if n is None:
            return consume(lists(df), i)
        for (chunk,) in df.select("chunk").distinct().collect():  # a file holds one
            seen.add(chunk)
            consume(whole(lists(df.where(F.col("chunk") == chunk)), chunk), i)

    stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if n is not None:
        none = spark.createDataFrame([], "src long, neighbors array<bigint>")
        for chunk in sorted(set(range(chunks)) - seen):
            consume(whole(none, chunk), -1)
