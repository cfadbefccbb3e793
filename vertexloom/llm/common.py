"""Expressions and storage helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone. lower() does just that to texts of ASCII, and is several times faster than translate()."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def n_words(col: Column) -> Column:
    """Number of words, from the pieces between runs of white space."""
    pieces = F.size(F.split(col, r"[\x20\x09-\x0D]+", -1))
    return (pieces - _edge(F.substring(col, 1, 1)) - F.when(F.length(col) > 0, _edge(F.substring(col, -1, 1))).otherwise(0)).cast("long")


def _edge(char: Column) -> Column:
    """1 where a text's first or last character leaves an empty piece beside it, or the text is empty."""
    return F.when((char == "") | char.rlike(r"^[\x20\x09-\x0D]$"), 1).otherwise(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process
    (tests). On a cluster it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.vertexloom.shared", None)
        if not named:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
            spark.conf.set("spark.vertexloom.shared", named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Whether Spark deletes an execution's shuffle files as it ends. Nothing reads those behind a table once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows with their lineage cut, as a table in the shared folder: it outlives the executors that wrote it. The
    shuffle files behind it go at once."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be broadcast.
MAX_BROADCAST = 32 << 20


def small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if the sizes of its rows add up to MAX_BROADCAST bytes at most; else it is joined by shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST else df


def removed(*tables: DataFrame) -> None:
    """Deletes the files behind tables that stored() has written, once nothing will read them again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
