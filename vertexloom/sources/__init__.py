"""Readers and writers of graph files. Paths go through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.transforms import running

#: format: its extensions, first the one written by default.
EXTENSIONS = {"metis": ("metis", "graph"), "parhip": ("parhip", "bgf"), "plain-edgelist": ("plain-edgelist", "edgelist", "txt"), "weighted-binary-edgelist": ("wbel",), "netd-are": ("netD",), "hmetis": ("hgr", "hmetis"), "dot": ("dot",), "coordinates": ("xyz",), "binary-edgelist": ("bin",), "xtrapulp": ("xtrapulp",), "kargb": ("kargb",)}


def format_of(path: str) -> str:
    ext = path.rpartition(".")[2]
    for name, known in EXTENSIONS.items():
        if ext in known:
            return name
    raise ValueError(f"no format for {path!r}")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """line, value of a text file. The number of a line is what the format means by it, so this is the one use of an RDD: it
    counts the lines of each partition and numbers them in order, without a sort."""
    rows = spark.read.text(path).rdd.map(lambda r: r[0]).zipWithIndex()
    return rows.map(lambda x: (x[1], x[0])).toDF("line long, value string")


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Line k holds the neighbours of vertex k, from 1; lines of % are comments; blank lines are vertices without neighbours."""
    lines = spark.read.text(path).where("not startswith(ltrim(value), '%')")
    first = lines.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("line long, value string")
    head = first.where("line = 0").first()
    numbers = [int(x) for x in (head["value"] if head else "").split()]
    if not numbers:
        return Graph(spark.createDataFrame([], "src long, dst long"), 0)
    n, fmt = numbers[0], f"{numbers[2] if len(numbers) > 2 else 0:03d}"
    if set(fmt) - {"0", "1"} or fmt[0] == "1":
        raise ValueError(f"unknown METIS format {fmt}")
    own, weighted = int(fmt[1]), fmt[2] == "1"
    rows = first.where((F.col("line") > 0) & (F.col("line") <= n)).select((F.col("line") - 1).alias("id"), F.expr("transform(filter(split(value, '[ \\t]+'), x -> x <> ''), x -> cast(x as bigint))").alias("x"))
    rows = rows.withColumn("e", F.slice("x", F.lit(1 + own), F.greatest(F.lit(0), F.size("x") - own)))
    points = spark.range(n).join(rows.select("id", F.get("x", F.lit(0)).alias("weight")), "id", "left") if own else None
    if weighted:
        pairs = F.transform(F.sequence(F.lit(1), F.size("e") - 1, F.lit(2)), lambda i: F.struct((F.element_at("e", i) - 1).alias("dst"), F.element_at("e", i + 1).alias("weight")))
        edges = rows.where(F.size("e") > 1).select(F.col("id").alias("src"), F.explode(pairs).alias("p")).select("src", "p.dst", "p.weight")
    else:
        edges = rows.select(F.col("id").alias("src"), F.explode("e").alias("dst")).withColumn("dst", F.col("dst") - 1)
    return Graph(edges, n, points)


def read_edgelist(spark: SparkSession, path: str, base: int = 0) -> Graph:
    """u v on each line; n is the largest id and one."""
    parts = F.split(F.trim("value"), r"\s+")
    edges = spark.read.text(path).where("trim(value) rlike '^[0-9]'").select((parts[0].cast("long") - base).alias("src"), (parts[1].cast("long") - base).alias("dst"))
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(edges, 0 if n is None else n + 1)


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_weighted_binary(spark: SparkSession, path: str, id_width: int = 8, weight_width: int = 8) -> Graph:
    """Records u, v, w without a header."""
    kind = np.dtype([("src", f"<u{id_width}"), ("dst", f"<u{id_width}"), ("weight", f"<i{weight_width}")])

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                x = np.frombuffer(data, kind)
                yield pd.DataFrame({k: x[k].astype(np.int64) for k in kind.names})

    edges = _bytes(spark, path).mapInPandas(run, "src long, dst long, weight long")
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(edges, 0 if n is None else n + 1)


def read_parhip(spark: SparkSession, path: str) -> Graph:
    """Binary CSR: version, n, m as 64 bits; n + 1 byte offsets; heads; vertex weights; edge weights. Bits of the version, negated:
    1 edge weights, 2 vertex weights, 4, 8, 16, 32 for 64-bit offsets, ids, vertex and edge weights."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                version, n, m = struct.unpack_from("<3Q", data)
                wide = lambda bit: 4 if version & bit else 8
                at = 24 + (n + 1) * wide(4)
                offsets = (np.frombuffer(data, f"<u{wide(4)}", n + 1, 24).astype(np.int64) - at) // wide(8)
                heads = np.frombuffer(data, f"<u{wide(8)}", m, at).astype(np.int64)
                at += m * wide(8) + (0 if version & 2 else n * wide(16))
                out = {"src": np.repeat(np.arange(n), np.diff(offsets)), "dst": heads}
                out["weight"] = pd.array([None] * m, "Int64") if version & 1 else np.frombuffer(data, f"<i{wide(32)}", m, at).astype(np.int64)
                yield pd.DataFrame(out)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame([struct.unpack_from("<3Q", x) for x in pdf["content"]], columns=["version", "n", "m"])

    head = _bytes(spark, path).mapInPandas(sizes, "version long, n long, m long").first()
    edges = _bytes(spark, path).mapInPandas(run, "src long, dst long, weight long")
    return Graph(edges if not head["version"] & 1 else edges.drop("weight"), head["n"])


def read_netd(spark: SparkSession, path: str) -> DataFrame:
    """Pins (net, vertex, direction) of a netlist: vertex names, s where a net begins (l: it goes on), and a direction. The net of a
    line is a running count of its s."""
    rows = _numbered(spark, path).where("line >= 5")
    p = F.split(F.trim("value"), r"\s+")
    rows = rows.select("line", p[0].alias("name"), (p[1] == "s").cast("long").alias("starts"), F.coalesce(F.get(p, F.lit(2)), F.lit("B")).alias("direction"))
    rows = running(rows, "line", "starts", "net").withColumn("net", F.col("net") + F.col("starts") - 1)
    return rows.select("net", F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("vertex"), "direction")


def read_kargb(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (row, col, r, g, b)."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                if data[:5] != b"KARGB":
                    raise ValueError("not a KARGB image")
                rows, cols = struct.unpack_from("<2Q", data, 5)
                x = np.frombuffer(data, np.uint8, rows * cols * 3, 21).reshape(-1, 3).astype(np.int16)
                at = np.arange(rows * cols)
                yield pd.DataFrame({"row": at // cols, "col": at % cols, "r": x[:, 0], "g": x[:, 1], "b": x[:, 2]})

    return _bytes(spark, path).mapInPandas(run, "row long, col long, r smallint, g smallint, b smallint")


def read_distribution(spark: SparkSession, path: str, prefix_sums: bool = False) -> DataFrame:
    """pe, first, last from a count for each line, or from prefix sums."""
    rows = _numbered(spark, path).where("trim(value) <> ''").select(F.col("line").alias("pe"), F.trim("value").cast("long").alias("x"))
    w = Window.orderBy("pe")
    if prefix_sums:
        return rows.select("pe", "x", F.lead("x").over(w).alias("last")).where("last is not null").select("pe", F.col("x").alias("first"), "last")
    upto = F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("pe", (upto - F.col("x")).alias("first"), upto.alias("last"))


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> Graph:
    readers = {"metis": read_metis, "parhip": read_parhip, "plain-edgelist": read_edgelist, "weighted-binary-edgelist": read_weighted_binary}
    return readers[fmt or format_of(path)](spark, path)


# Writers. Text is written by Spark, in order of line keys; the part files of a range sort, read in order, are the file.


def _adjacency(g: Graph) -> DataFrame:
    w = "weight" in g.edges.columns
    e = g.edges.withColumn("_x", F.concat_ws(" ", (F.col("dst") + 1).cast("string"), *[F.col("weight").cast("string")] if w else []))
    lists = e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "_x"))), lambda x: x["_x"]), " ").alias("_l"))
    own = "weight" in (g.points.columns if g.points is not None else [])
    rows = g.vertices.join(lists, "id", "left")
    return rows.select("id", F.trim(F.concat_ws(" ", *[F.col("weight").cast("string")] if own else [], F.coalesce("_l", F.lit("")))).alias("value"))


def _nets(pairs: DataFrame) -> DataFrame:
    """Edges with k, their number from 1 in the order of (src, dst)."""
    numbered = running(pairs.withColumn("_one", F.lit(1)), "src", "_one", "_k")
    return numbered.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst")) + F.min("_k").over(Window.partitionBy("src"))).drop("_one", "_k")


def lines_of(g: Graph, fmt: str) -> DataFrame:
    """k, value: the lines of a text format; k orders them, the header first."""
    spark, e = g.edges.sparkSession, g.edges
    w = "weight" in e.columns
    own = g.points is not None and "weight" in g.points.columns
    head = lambda s: spark.createDataFrame([(-1, -1, s)], "a long, b long, value string")
    if fmt == "plain-edgelist":
        return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws("\t", "src", "dst").alias("value"))
    m = e.count()
    if fmt in ("edgelist", "edgelist-undirected"):
        kept = e.where("src <= dst") if fmt.endswith("undirected") else e
        return head(f"p {g.n} {m}").unionAll(kept.select("src", "dst", F.format_string("e %d %d", F.col("src") + 1, F.col("dst") + 1)))
    code = f"{int(own)}{int(w)}"
    if fmt == "metis":
        return head(f"{g.n} {m // 2}" + (f" {code}" if own or w else "")).unionAll(_adjacency(g).select("id", F.lit(0).cast("long"), "value"))
    if fmt == "freight-netl-ep":
        # Nets first, ids from 0, a weight of one after each; loops and weights have no place in it.
        kept = e.where("src < dst")
        return head(f"{kept.count()} {g.n} 11").unionAll(kept.select("src", "dst", F.format_string("1 %d 1 %d 1", "src", "dst")))
    if fmt == "freight-netl":
        # A vertex's weight, then its nets in the order of its neighbours, each with its weight. Nets are numbered as their edges come.
        nets = _nets(e.where("src <= dst").select("src", "dst").distinct()).select(F.col("src").alias("_u"), F.col("dst").alias("_v"), "k")
        met = e.join(nets, (F.least("src", "dst") == F.col("_u")) & (F.greatest("src", "dst") == F.col("_v")))
        said = F.concat_ws(" ", F.col("k").cast("string"), (F.col("weight") if w else F.lit(1)).cast("string"))
        lists = met.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", said.alias("x")))), lambda x: x["x"]), " ").alias("_l"))
        first = F.col("weight").cast("string") if own else F.lit("1")
        return head(f"{g.n} {m // 2} 11").unionAll(g.vertices.join(lists, "id", "left").select("id", F.lit(0).cast("long"), F.concat_ws(" ", first, "_l")))
    if fmt in ("hmetis", "hmetis-directed"):
        kept = e if fmt.endswith("directed") else e.where("src < dst")
        pins = F.concat_ws(" ", *[F.col("weight").cast("string")] if w else [], (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"))
        body = kept.select("src", "dst", pins)
        if own:
            body = body.unionAll(g.points.select(F.lit(1 << 62).cast("long"), "id", F.col("weight").cast("string")))
        return head(f"{kept.count()} {g.n}" + (f" {'1' * own}{int(w)}" if own or w else "")).unionAll(body)
    if fmt == "hmetis-ep":
        pair = e.where("src < dst").select("src", "dst")
        nets = _nets(pair).select(F.explode(F.array("src", "dst")).alias("id"), "k").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), " ").alias("value"))
        rows = spark.range(g.n).join(nets, "id", "left").select("id", F.lit(0).cast("long"), F.coalesce("value", F.lit("")))
        return head(f"{g.n} {pair.count()}").unionAll(rows)
    if fmt in ("dot", "dot-directed"):
        way, arrow = ("digraph", "->") if fmt.endswith("directed") else ("graph", "--")
        kept = e if fmt.endswith("directed") else e.where("src < dst")
        out = head(f"{way} G {{").unionAll(kept.select("src", "dst", F.format_string(f"%d{arrow}%d", F.col("src") + 1, F.col("dst") + 1)))
        if g.points is not None and "x" in g.points.columns:
            out = out.unionAll(g.points.select(F.lit(-1).cast("long"), "id", F.format_string('%d[pos="%f,%f!"]', F.col("id") + 1, F.col("x") * 10, F.col("y") * 10)))
        return out.unionAll(spark.createDataFrame([((1 << 62) + 1, 0, "}")], "a long, b long, value string"))
    if fmt == "coordinates":
        z = F.col("z") if "z" in g.points.columns else F.lit(0.0)
        return g.points.select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("%.5f %.5f %.5f", F.col("x"), F.col("y"), z).alias("value"))
    raise ValueError(f"unknown text format {fmt!r}")


def bytes_of(g: Graph, fmt: str, id_width: int = 8, weight_width: int = 8) -> tuple[bytes, DataFrame]:
    """A header and rows (a, b, value): the records of a binary format, in the order of (a, b)."""
    e, kind = g.edges, f"<u{id_width}"
    if fmt.endswith("undirected") or fmt == "xtrapulp":
        e = e.where("src <= dst")
    weighted = fmt == "weighted-binary-edgelist"
    if weighted and "weight" not in e.columns:
        e = e.withColumn("weight", F.lit(1).cast("long"))

    def run(batches):
        for pdf in batches:
            fields = [("s", kind), ("d", kind)] + ([("w", f"<i{weight_width}")] if weighted else [])
            out = np.zeros(len(pdf), fields)
            out["s"], out["d"] = pdf["src"], pdf["dst"]
            if weighted:
                out["w"] = pdf["weight"]
            raw, size = out.tobytes(), out.itemsize
            yield pd.DataFrame({"a": pdf["src"], "b": pdf["dst"], "value": [raw[i * size : (i + 1) * size] for i in range(len(pdf))]})

    rows = e.mapInPandas(run, "a long, b long, value binary")
    return (b"" if fmt in ("xtrapulp", "weighted-binary-edgelist") else struct.pack("<2Q", g.n, g.edges.count())), rows


def write_graph(g: Graph, path: str, fmt: str | None = None, one_file: bool = True) -> None:
    """Text formats become a folder of parts in order, by a range sort; one_file gathers them, in order and a part at a time, to a
    single file on the driver's machine, as binary formats and most readers of these formats need."""
    fmt = fmt or format_of(path)
    if fmt == "noop":
        g.edges.write.format("noop").mode("overwrite").save()
        return
    if fmt == "parhip":
        return _write_parhip(g, path)
    header, rows = (b"", lines_of(g, fmt)) if fmt in TEXT else bytes_of(g, fmt)
    if not one_file and fmt in TEXT:
        rows.toDF("a", "b", "value").orderBy("a", "b").select("value").write.mode("overwrite").text(path)
        return
    with Path(path).open("wb") as f:
        f.write(header)
        for r in rows.toDF("a", "b", "value").orderBy("a", "b").select("value").toLocalIterator():
            f.write(r[0].encode() + b"\n" if fmt in TEXT else bytes(r[0]))


TEXT = ("plain-edgelist", "edgelist", "edgelist-undirected", "metis", "hmetis", "hmetis-directed", "hmetis-ep", "freight-netl", "freight-netl-ep", "dot", "dot-directed", "coordinates")


def _write_parhip(g: Graph, path: str) -> None:
    weighted = "weight" in g.edges.columns
    e = g.edges.orderBy("src", "dst")
    degree = g.edges.sparkSession.range(g.n).join(g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id", "left").orderBy("id").select(F.coalesce("k", F.lit(0)))
    with Path(path).open("wb") as f:
        m = g.edges.count()
        f.write(struct.pack("<3Q", 2 | (not weighted), g.n, m))
        at = 24 + 8 * (g.n + 1)
        f.write(struct.pack("<Q", at))
        for r in degree.toLocalIterator():
            at += 8 * r[0]
            f.write(struct.pack("<Q", at))
        for c in ("dst", "weight") if weighted else ("dst",):
            for r in e.select(c).toLocalIterator():
                f.write(struct.pack("<q", r[0]))


def write_kargb(pixels: DataFrame, rows: int, cols: int, path: str) -> None:
    with Path(path).open("wb") as f:
        f.write(b"KARGB" + struct.pack("<2Q", rows, cols))
        for r in pixels.orderBy("row", "col").select("r", "g", "b").toLocalIterator():
            f.write(bytes(r))


def boundary(labels: DataFrame) -> DataFrame:
    """labels (row, col, block) with edge: whether a neighbour on one of four sides lies in another block."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    other = lambda w, f: F.coalesce(f("block").over(w) != F.col("block"), F.lit(False))
    return labels.withColumn("edge", other(across, F.lag) | other(across, F.lead) | other(down, F.lag) | other(down, F.lead))
