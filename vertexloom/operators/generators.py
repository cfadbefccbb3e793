"""Generators: row-local functions of a seed and a row id, so that a seed gives one graph for any number of partitions.

Undirected models hold both directions of an edge. family="portable" uses MD5, which any SQL engine can repeat."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import div, from_triangle, squared_distance
from ..graph import Graph
from ..hashing import bits52, uniform
from ..permutation import permuted
from ..shipping import ship
from .transforms import dedupe, permute, ranked_permutation, symmetrize


def both_ways(e: DataFrame) -> DataFrame:
    """Both directions of canonical edges (a loop once), by one explode: no shuffle, no second run of what makes e."""
    pair = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return e.withColumn("_e", F.explode(pair)).select("_e.src", "_e.dst", *[c for c in e.columns if c not in ("src", "dst")])


def _chosen(spark: SparkSession, cells: int, m: int, seed: int) -> DataFrame:
    """m distinct numbers below cells: the images of 0 to m - 1 under a permutation. No shuffle."""
    ship(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permuted(b.column(0).to_numpy(), cells, seed))], names=["cell"])

    return spark.range(m).mapInArrow(run, "cell long")


def _ranked(spark: SparkSession, cells: int, m: int, seed: int) -> DataFrame:
    """The m cells of lowest portable hash; for small universes, as SQL can repeat it."""
    rows = spark.range(cells).select(F.col("id").alias("cell"), bits52(seed, F.col("id"), family="portable").alias("h"))
    return rows.orderBy("h", "cell").limit(m).select("cell")


def gnm(spark: SparkSession, n: int, m: int, seed: int = 1, directed: bool = False, self_loops: bool = False, family: str = "native") -> Graph:
    if directed:
        cells = n * n if self_loops else n * (n - 1)
    else:
        cells = n * (n + 1) // 2 if self_loops else n * (n - 1) // 2
    if not 0 <= m <= cells < 1 << 62:
        raise ValueError(f"{m} edges of {cells} possible")
    c = F.col("cell")
    rows = _ranked(spark, cells, m, seed) if family == "portable" else _chosen(spark, max(1, cells), m, seed)
    if directed:
        width = n if self_loops else max(1, n - 1)
        src, dst = F.expr(f"cell div {width}"), F.pmod(c, F.lit(width))
        dst = dst if self_loops else dst + F.when(dst >= src, 1).otherwise(0)
        return Graph(rows.select(src.alias("src"), dst.cast("long").alias("dst")), n, directed=True)
    row, col = from_triangle(c)
    low = row - 1 if self_loops else row
    return Graph(both_ways(rows.select(low.cast("long").alias("src"), col.alias("dst"))), n)


def gnp(spark: SparkSession, n: int, p: float, seed: int = 1, directed: bool = False, self_loops: bool = False, family: str = "native") -> Graph:
    """Native: the number of edges is drawn from its binomial, then as many cells. Portable: a hash for each cell."""
    if family == "portable":
        cells = n * n
        s, t = F.expr(f"id div {n}"), F.pmod(F.col("id"), F.lit(n))
        rows = spark.range(cells).select(s.alias("src"), t.alias("dst"))
        rows = rows.where("src <> dst") if not self_loops else rows
        rows = rows if directed else rows.where("src >= dst")
        rows = rows.where(uniform(seed, F.col("src"), F.col("dst"), family=family) < p)
        return Graph(rows if directed else both_ways(rows), n, directed=directed)
    cells = (n * n if self_loops else n * (n - 1)) if directed else (n * (n + 1) if self_loops else n * (n - 1)) // 2
    return gnm(spark, n, int(np.random.default_rng(seed).binomial(cells, p)), seed, directed, self_loops)


def points(spark: SparkSession, n: int, dims: int, seed: int, family: str = "native") -> DataFrame:
    return spark.range(n).select("id", *[uniform(seed, F.col("id"), F.lit(d), family=family).alias("xyz"[d]) for d in range(dims)])


def near_pairs(pts: DataFrame, radius: float, names: list[str], keep: list[Column] | None = None, box: float = 1.0) -> DataFrame:
    """Pairs a < b of points within radius (inclusive), by an equi-join on grid cells: one side stands in its own cell, the other in
    all cells around it."""
    size = max(radius, 1e-9)
    cell = [F.floor(F.col(c) / F.lit(size)).cast("long") for c in names]
    a = pts.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names], *[x.alias(f"_c{i}") for i, x in enumerate(cell)])
    b = pts.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names], *[x.alias(f"_c{i}") for i, x in enumerate(cell)])
    for i in range(len(names)):
        b = b.withColumn(f"_c{i}", F.explode(F.array(F.col(f"_c{i}") - 1, F.col(f"_c{i}"), F.col(f"_c{i}") + 1)))
    d2 = squared_distance([F.col(f"a_{c}") for c in names], [F.col(f"b_{c}") for c in names])
    return a.join(b, [f"_c{i}" for i in range(len(names))]).where("a < b").withColumn("d2", d2).where(F.col("d2") <= F.lit(radius) * F.lit(radius)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "d2")


def rgg(spark: SparkSession, n: int, radius: float, dims: int = 2, seed: int = 1, family: str = "native", weights: tuple[int, int] | None = None) -> Graph:
    """weights (begin, end): from the distance, begin + floor((end - begin) d / r), held below end."""
    pts = points(spark, n, dims, seed, family)
    e = near_pairs(pts, radius, list("xyz"[:dims]))
    if weights:
        begin, end = weights
        e = e.withColumn("weight", F.least(F.lit(end - 1), begin + F.floor((end - begin) * F.sqrt("d2") / F.lit(radius))).cast("long"))
    return Graph(both_ways(e.drop("d2")), n, pts)


def rhg(spark: SparkSession, n: int, gamma: float, radius: float, seed: int = 1, family: str = "native") -> Graph:
    """A disk of the hyperbolic plane: uniform angles, radii by the inverse distribution; edges up to distance radius. Bands of
    radius pair off, and in each pair angles are binned no finer than the widest angle that can be linked."""
    alpha, bands = (gamma - 1) / 2, max(1, min(64, math.ceil(radius)))
    u = uniform(seed, F.col("id"), F.lit("r"), family=family)
    pts = spark.range(n).select("id", (2 * math.pi * uniform(seed, F.col("id"), F.lit("phi"), family=family)).alias("phi"), (F.acosh(1 + u * F.lit(math.cosh(alpha * radius) - 1)) / F.lit(alpha)).alias("r"))
    pts = pts.withColumn("band", F.least(F.lit(bands - 1), F.floor(F.col("r") * bands / F.lit(radius))).cast("int"))

    def reach(i: int, j: int) -> float:
        """The widest angle between linked points of bands i and j, whose inner edges bound it."""
        a, b = i * radius / bands, j * radius / bands
        if a + b <= radius or not a or not b:
            return math.pi
        x = (math.cosh(a) * math.cosh(b) - math.cosh(radius)) / (math.sinh(a) * math.sinh(b))
        return math.acos(max(-1.0, min(1.0, x))) if x < 1 else 0.0

    plan = [(i, j, max(1, min(1 << 24, int(2 * math.pi / max(reach(i, j), 1e-7))))) for i in range(bands) for j in range(i, bands)]
    pairs = spark.createDataFrame(plan, "i int, j int, bins long")  # at most 64 x 65 / 2 rows
    at = lambda bins: F.least(bins - 1, F.floor(F.col("phi") / (2 * math.pi) * bins)).cast("long")
    cols = lambda p: [F.col("id").alias(p), F.col("phi").alias(f"phi_{p}"), F.col("r").alias(f"r_{p}")]
    a = pts.join(F.broadcast(pairs), F.col("band") == F.col("i")).select("i", "j", at(F.col("bins")).alias("bin"), *cols("a"))
    b = pts.join(F.broadcast(pairs), F.col("band") == F.col("j")).withColumn("bin", at(F.col("bins")))
    b = b.withColumn("bin", F.explode(F.array_distinct(F.array(F.pmod(F.col("bin") - 1, F.col("bins")), F.col("bin"), F.pmod(F.col("bin") + 1, F.col("bins")))))).select("i", "j", "bin", *cols("b"))
    met = a.join(b, ["i", "j", "bin"]).where("i < j or a < b")
    cosh = F.cosh("r_a") * F.cosh("r_b") - F.sinh("r_a") * F.sinh("r_b") * F.cos(F.col("phi_a") - F.col("phi_b"))
    e = met.where(cosh <= F.lit(math.cosh(radius))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return Graph(both_ways(e), n, pts.select("id", (F.col("r") * F.cos("phi")).alias("x"), (F.col("r") * F.sin("phi")).alias("y")))


def ba(spark: SparkSession, n: int, d: int, seed: int = 1, directed: bool = False, family: str = "native") -> Graph:
    """Preferential attachment: slot v d + i of vertex v copies the end of a random earlier half-edge; the chain of copies is walked
    row by row. A half-edge's draw depends on its number alone, so no row waits for another."""
    ship(spark)

    def run(batches):
        for b in batches:
            slot = b.column(0).to_numpy()
            r = 2 * slot + 1
            open_ = np.ones(len(r), bool)
            while open_.any():
                r[open_] = draws(r[open_], seed)
                open_ &= r % 2 == 1
            yield pa.RecordBatch.from_arrays([pa.array(slot // d), pa.array(r // (2 * d))], names=["src", "dst"])

    draws = _draws if family == "portable" else _mixed_draws
    e = spark.range(n * d).mapInArrow(run, "src long, dst long")
    return Graph(dedupe(e) if directed else symmetrize(e, keep_loops=True), n, directed=directed)


def _mixed_draws(r: np.ndarray, seed: int) -> np.ndarray:
    """A number below each r, by a 64-bit mix: uniform however large r is."""
    h = r.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) % r.astype(np.uint64)).astype(np.int64)


def _draws(r: np.ndarray, seed: int) -> np.ndarray:
    """A number below each r: the Lehmer step that SQL can repeat; for r below 2^31."""
    h = ((r + seed) % 2147483647 * 48271 + 11) % 2147483647
    h = (h * 69621 + 7) % 2147483647
    return h % r


def lattice(spark: SparkSession, sides: tuple[int, ...], p: float = 1.0, periodic: bool = False, seed: int = 1, family: str = "native") -> Graph:
    """A grid of two or three sides. An edge stays with probability p, by a hash of the canonical pair."""
    n, id_ = math.prod(sides), F.col("id")
    steps, stride = [], 1
    for k in sides:
        at = F.pmod(div(id_, stride), F.lit(k))
        if k > 1:
            steps.append(F.when(at < k - 1, id_ + stride))
            if periodic and k > 2:
                steps.append(F.when(at == k - 1, id_ - (k - 1) * stride))
        stride *= k
    rows = spark.range(n).select(id_.alias("src"), F.explode((F.array_compact(F.array(*steps)) if steps else F.array()).cast("array<bigint>")).alias("dst"))
    if p < 1:
        rows = rows.where(uniform(seed, F.least("src", "dst"), F.greatest("src", "dst"), family=family) < p)
    stride, coordinates = 1, []
    for name, k in zip("xyz", sides, strict=False):
        coordinates.append((F.pmod(div(id_, stride), F.lit(k)) / F.lit(float(k))).alias(name))
        stride *= k
    return Graph(both_ways(rows), n, spark.range(n).select("id", *coordinates))


def path(spark: SparkSession, n: int, periodic: bool = False, permute_seed: int | None = None, family: str = "native") -> Graph:
    rows = spark.range(n if periodic and n > 1 else max(0, n - 1)).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"))
    if permute_seed is not None and family == "portable":
        mapping = ranked_permutation(spark.range(n), bits52(permute_seed, F.col("id"), family=family))
        a, b = (mapping.select(F.col("id").alias(c), F.col("new").alias(f"_{c}")) for c in ("src", "dst"))
        rows = rows.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    elif permute_seed is not None:
        rows = permute(rows, n, permute_seed)
    return Graph(rows, n, directed=True)


def rmat_edges(spark: SparkSession, log_n: int, m: int, a: float, b: float, c: float, seed: int = 1, family: str = "native") -> DataFrame:
    """m raw edges, a quadrant for each level."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    draws = [uniform(seed, F.col("id"), F.lit(k), family=family).alias(f"u{k}") for k in range(log_n)]
    rows = spark.range(m).select("id", *draws)
    for k in range(log_n):
        u = F.col(f"u{k}")
        src = src + F.when(u >= a + b, 1 << k).otherwise(0)
        dst = dst + F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1 << k).otherwise(0)
    return rows.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def rmat(spark: SparkSession, n: int, m: int, a: float, b: float, c: float, seed: int = 1, directed: bool = False, self_loops: bool = False, family: str = "native") -> Graph:
    log_n = n.bit_length() - 1
    e = rmat_edges(spark, log_n, m, a, b, c, seed, family)
    e = e if self_loops else e.where("src <> dst")
    return Graph(dedupe(e) if directed else symmetrize(e, keep_loops=self_loops), 1 << log_n, directed=directed)


def kronecker(spark: SparkSession, n: int, m: int, seed: int = 1, directed: bool = False, self_loops: bool = False, family: str = "native") -> Graph:
    """All quadrants alike; ends are scrambled by an affine permutation of [0, 2^k)."""
    log_n = n.bit_length() - 1
    scrambled = lambda c: F.pmod(F.col(c) * 1664525 + 1013904223, F.lit(1 << log_n)).alias(c)
    e = rmat_edges(spark, log_n, m, 0.25, 0.25, 0.25, seed, family).select(scrambled("src"), scrambled("dst"))
    e = e if self_loops else e.where("src <> dst")
    return Graph(dedupe(e) if directed else symmetrize(e, keep_loops=self_loops), 1 << log_n, directed=directed)


#: Offsets (row, column) of each neighbourhood that lead to a later pixel; 24 without its diagonal four is 20.
def _offsets(neighborhood: int) -> list[tuple[int, int]]:
    reach = 2 if neighborhood in (20, 24) else 1
    every = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0)]
    if neighborhood == 4:
        return [(0, 1), (1, 0)]
    return [x for x in every if neighborhood != 20 or (abs(x[0]), abs(x[1])) != (1, 1)]


def image_weight(model: str, a: list[Column], b: list[Column]) -> Column:
    """Of two pixels' channels: l2, inv-l2, ratio, inv-ratio or similarity."""
    l2 = F.sqrt(squared_distance(a, b))
    ratio = reduce(lambda x, y: x * y, [(F.least(x, y) + 1) / (F.greatest(x, y) + 1) for x, y in zip(a, b, strict=True)])
    unit = squared_distance([x / 255.0 for x in a], [y / 255.0 for y in b])
    return {"l2": l2, "inv-l2": F.lit(255 * math.sqrt(3) + 1) - l2, "ratio": 1.0 / ratio, "inv-ratio": ratio, "similarity": F.exp(-unit / (2 * 0.1 * 0.1))}[model]


def image_mesh(pixels: DataFrame, columns: int, rows: int, model: str = "ratio", multiplier: float = 255.0, offset: float = 0.0, low: float = 1.0, high: float = math.inf, neighborhood: int = 4) -> Graph:
    """pixels (row, col, r, g, b): links of neighbours whose weight, model * multiplier + offset, lies in [low, high]; it is floored then."""
    channels = ["r", "g", "b"]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _offsets(neighborhood)]))
    a = pixels.select((F.col("row") * columns + F.col("col")).alias("src"), "row", "col", *[F.col(c).cast("double").alias(f"a_{c}") for c in channels], shift.alias("s"))
    a = a.select("src", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), *[f"a_{c}" for c in channels])
    b = pixels.select("row", "col", (F.col("row") * columns + F.col("col")).alias("dst"), *[F.col(c).cast("double").alias(f"b_{c}") for c in channels])
    w = image_weight(model, [F.col(f"a_{c}") for c in channels], [F.col(f"b_{c}") for c in channels]) * multiplier + offset
    e = a.join(b, ["row", "col"]).select("src", "dst", w.alias("weight")).where(F.col("weight") >= low)
    e = e if math.isinf(high) else e.where(F.col("weight") <= high)
    e = e.withColumn("weight", F.floor("weight").cast("long"))
    return Graph(both_ways(e), columns * rows)


def delaunay(pts: np.ndarray) -> np.ndarray:
    """Edges (a < b) of the Delaunay triangulation of points (n, 2), by inserting them one by one."""
    n = len(pts)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    big = 1e4 * (np.ptp(pts, 0).max() + 1)
    xy = np.vstack([pts, pts.mean(0) + [[-big, -big], [big, -big], [0, big]]])
    triangles = {(n, n + 1, n + 2)}
    circle = {}

    def around(t):
        (ax, ay), (bx, by), (cx, cy) = (xy[i] for i in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    circle[(n, n + 1, n + 2)] = around((n, n + 1, n + 2))
    for i in range(n):
        x, y = xy[i]
        bad = [t for t in triangles if (x - circle[t][0]) ** 2 + (y - circle[t][1]) ** 2 < circle[t][2]]
        sides: dict[tuple, int] = {}
        for t in bad:
            for s in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                sides[tuple(sorted(s))] = sides.get(tuple(sorted(s)), 0) + 1
        for t in bad:
            triangles.discard(t)
            circle.pop(t)
        for s, k in sides.items():
            if k == 1:
                t = tuple(sorted((*s, i)))
                triangles.add(t)
                circle[t] = around(t)
    edges = {tuple(sorted(s)) for t in triangles for s in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if max(s) < n}
    return np.array(sorted(edges), np.int64).reshape(-1, 2)


def rdg2d(spark: SparkSession, n: int, seed: int = 1, family: str = "native") -> Graph:
    """Delaunay edges of n uniform points, triangulated in one task; for n up to some ten thousand."""
    ship(spark)
    pts = points(spark, n, 2, seed, family)

    def run(pdf):
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        e = delaunay(pdf[["x", "y"]].to_numpy())
        import pandas as pd

        return pd.DataFrame({"src": ids[e[:, 0]], "dst": ids[e[:, 1]]})

    return Graph(both_ways(pts.withColumn("_tile", F.lit(0)).groupBy("_tile").applyInPandas(run, "src long, dst long")), n, pts)


