"""Registered queries and the SQL that they are held against.

The graphs come from the driver's tables: parts and suppliers (part_supp), customers and orders (cust_order), orders and parts
(order_part); ids of the second kind are shifted by OFF."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, tools
from ..functions import below, bit_length, from_triangle
from ..graph import Graph
from ..hashing import bits52, sql_bits52, sql_uniform, uniform
from ..operators import generators as gen
from ..operators import stats, transforms, validate, weights

OFF = 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFF).alias("dst"))


def part_supp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFF).alias("dst"), F.col("l_quantity").cast("long").alias("weight"))


def cust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + OFF).alias("dst"))


def part_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both keys below N, so that loops, duplicates and one-way edges occur."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % N).alias("src"), ((F.col("l_orderkey") + F.col("l_suppkey")) % N).alias("dst"))


N = 2000
_PS = f"SELECT l_partkey AS src, l_suppkey + {OFF} AS dst FROM lineitem"
_PSW = f"SELECT l_partkey AS src, l_suppkey + {OFF} AS dst, l_quantity::BIGINT AS weight FROM lineitem"
_PM = f"SELECT l_partkey % {N} AS src, (l_orderkey + l_suppkey) % {N} AS dst FROM lineitem"
_SYM = "SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst"
_BITS = "length(ltrim({0}::BIT::VARCHAR, '0'))"


def query(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _owner(v: str, n: int, parts: int) -> str:
    q, r = divmod(n, parts)
    return f"(CASE WHEN {v} < 0 OR {v} >= {n} THEN -1 WHEN {v} < {r * (q + 1)} THEN {v} // {q + 1} ELSE {r} + ({v} - {r * (q + 1)}) // {max(1, q)} END)::INT"


# Transforms.
query("symmetrize", lambda s, d: transforms.symmetrize(part_supp(s, d)), f"WITH e AS ({_PS}) {_SYM}")
query("dedupe", lambda s, d: transforms.dedupe(part_supp(s, d)), f"SELECT DISTINCT * FROM ({_PS})")
query("dedupe_weighted", lambda s, d: transforms.dedupe(part_supp_weighted(s, d)), f"SELECT src, dst, min(weight) AS weight FROM ({_PSW}) GROUP BY ALL")
query("drop_loops", lambda s, d: transforms.drop_loops(part_mod(s, d)), f"SELECT * FROM ({_PM}) WHERE src <> dst")
query("reverse", lambda s, d: transforms.reversed_edges(part_supp_weighted(s, d)), f"SELECT dst AS src, src AS dst, weight FROM ({_PSW})")
query("max_id", lambda s, d: transforms.max_id(part_supp(s, d)), f"SELECT max(greatest(src, dst)) + 1 AS n FROM ({_PS})")


def _csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = transforms.csr(transforms.dedupe(part_mod(spark, sf_dir)), spark.range(N))
    return c.select("src", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), "offset")


query("csr", _csr, f"""WITH e AS (SELECT DISTINCT * FROM ({_PM})), v AS (SELECT range AS src FROM range({N})),
    c AS (SELECT v.src, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS neighbors, count(e.dst) AS k FROM v LEFT JOIN e ON v.src = e.src GROUP BY v.src)
    SELECT src, neighbors, coalesce(sum(k) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""")
query("csr_explode", lambda s, d: transforms.from_csr(transforms.csr(transforms.dedupe(part_supp_weighted(s, d)))), ORACLES["dedupe_weighted"])
query("owner", lambda s, d: part_mod(s, d).select("src", transforms.owner(F.col("src"), N, 7).alias("pe")).distinct(), f"SELECT DISTINCT src, {_owner('src', N, 7)} AS pe FROM ({_PM})")
query("balanced_ranges", lambda s, d: transforms.balanced_ranges(s, N, 7), f"SELECT {_owner('range', N, 7)} AS pe, min(range) AS first, max(range) + 1 AS last FROM range({N}) GROUP BY ALL")


def _robin(c: str) -> str:
    q, r = divmod(N, 7)
    return f"(({c} % 7) * {q} + least({c} % 7, {r}) + {c} // 7)"


query("round_robin", lambda s, d: transforms.round_robin(part_mod(s, d), N, 7), f"SELECT {_robin('src')} AS src, {_robin('dst')} AS dst FROM ({_PM})")
_OWNERS = f"""e AS (SELECT DISTINCT * FROM ({_PM})), deg AS (SELECT range AS id, count(e.src) AS degree FROM range({N}) LEFT JOIN e ON range = e.src GROUP BY ALL),
    cum AS (SELECT *, sum(degree) OVER (ORDER BY id) AS upto, ceil(sum(degree) OVER () / {{0}}) AS size FROM deg),
    own AS (SELECT id, degree, greatest(0, ceil(upto / size) - 1)::INT AS pe FROM cum)"""
for _p in (4, 7):
    query(f"edge_balanced_ranges_{_p}", partial(lambda s, d, p: transforms.edge_balanced_ranges(transforms.dedupe(part_mod(s, d)), N, p), p=_p),
          f"WITH {_OWNERS.format(_p)} SELECT pe, min(id) AS first, max(id) + 1 AS last, sum(degree)::BIGINT AS edges FROM own GROUP BY pe")
query("redistribute", lambda s, d: transforms.redistribute(part_mod(s, d), N, 7), f"SELECT DISTINCT src, dst, {_owner('src', N, 7)} AS pe FROM ({_PM})")
query("redistribute_remapped", lambda s, d: transforms.redistribute(part_mod(s, d), N, 7, remap=True), f"SELECT DISTINCT src, dst, {_owner('src', N, 7)} AS pe FROM (SELECT {_robin('src')} AS src, {_robin('dst')} AS dst FROM ({_PM}))")
query("redistribute_by_edges", lambda s, d: transforms.redistribute(part_mod(s, d), N, 4, by_edges=True), f"WITH {_OWNERS.format(4)} SELECT e.src, e.dst, own.pe FROM e JOIN own ON e.src = own.id")
query("permute_ranked", lambda s, d: transforms.relabel(part_mod(s, d), transforms.ranked_permutation(s.range(N), bits52(3, F.col("id"), family="portable"))),
      f"WITH p AS (SELECT range AS id, row_number() OVER (ORDER BY {sql_bits52(3, 'range')}, range) - 1 AS new FROM range({N})) SELECT a.new AS src, b.new AS dst FROM ({_PM}) e JOIN p a ON e.src = a.id JOIN p b ON e.dst = b.id")
query("permute_inverse", lambda s, d: transforms.permute(transforms.permute(part_mod(s, d), N, 5), N, 5, back=True), _PM)
query("degree_weight", lambda s, d: transforms.weigh_by_degree(part_mod(s, d), s.range(2 * N), isolated=-1), f"SELECT range AS id, CASE count(e.src) WHEN 0 THEN -1 ELSE count(e.src) END AS weight FROM range({2 * N}) LEFT JOIN ({_PM}) e ON range = e.src GROUP BY range")
query("sorted_edges", lambda s, d: transforms.sorted_edges(transforms.dedupe(part_supp(s, d))), ORACLES["dedupe"])
query("drop_weights", lambda s, d: transforms.drop_weights(part_supp_weighted(s, d)), _PS)
query("distribution", lambda s, d: transforms.distribution(s.sql("SELECT * FROM VALUES (0, 0L, 5L), (1, 5L, 5L), (2, 5L, 9L), (3, 9L, 9L) AS t(pe, first, last)")), "SELECT * FROM (VALUES (0, 5::BIGINT), (1, 5), (2, 9), (3, 9)) t(pe, last)")


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.when(F.col("l_linenumber") % 3 == 0, "B").when(F.col("l_linenumber") % 3 == 1, "I").otherwise("O")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_partkey").alias("vertex"), way.alias("direction"))


query("netd_clique", lambda s, d: transforms.clique_expansion(_pins(s, d)), """WITH p AS (SELECT l_orderkey AS net, l_partkey AS v, CASE l_linenumber % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END AS d FROM lineitem)
    SELECT a.v AS src, b.v AS dst FROM p a JOIN p b ON a.net = b.net WHERE a.v <> b.v AND (a.d <> b.d OR a.d = 'B')""")


# Statistics.
query("degree_bins", lambda s, d: stats.degree_bins(transforms.symmetrize(part_supp(s, d))), f"WITH e AS ({_PS}), g AS ({_SYM}), d AS (SELECT src, count(*) AS c FROM g GROUP BY src) SELECT {_BITS.format('c')}::INT AS bin, count(*) AS vertices FROM d GROUP BY ALL")
query("degree_stats", lambda s, d: stats.degree_stats(transforms.dedupe(part_mod(s, d)), N), f"WITH {_OWNERS.format(4)} SELECT min(degree) AS min_degree, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree FROM deg")
query("totals", lambda s, d: stats.totals(part_mod(s, d), N), f"SELECT {N}::BIGINT AS n, count(*) AS m, round(count(*) / {N}.0::DOUBLE / {N - 1}.0::DOUBLE, 12) AS density FROM ({_PM})")
query("part_stats", lambda s, d: stats.part_stats(part_mod(s, d), N, 7), f"""WITH c AS (SELECT {_owner('src', N, 7)} AS pe, count(*) AS m FROM ({_PM}) GROUP BY ALL)
    SELECT min(m) AS min_m, round(avg(m), 6) AS avg_m, max(m) AS max_m, round(stddev_pop(m), 6) AS sd_m, round(max(m) / avg(m), 6) AS imbalance FROM c""")
query("locality", lambda s, d: stats.locality(part_mod(s, d), N, 7), f"SELECT round(sum(({_owner('src', N, 7)} = {_owner('dst', N, 7)})::INT) / count(*), 6) AS locality FROM ({_PM})")
query("ghosts", lambda s, d: stats.ghosts(part_mod(s, d), N, 7), f"WITH c AS (SELECT DISTINCT {_owner('src', N, 7)} AS pe, dst FROM ({_PM}) WHERE {_owner('src', N, 7)} <> {_owner('dst', N, 7)}) SELECT count(*) AS ghosts, round(count(*) / (count(*) + {N}), 6) AS fraction FROM c")
query("graphstats", lambda s, d: stats.graph_stats(transforms.dedupe(part_mod(s, d)), N, (10, 20, 30)), f"""WITH {_OWNERS.format(4)} SELECT count(*) AS n, sum(degree)::BIGINT AS m, min(degree) AS min_degree, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree,
    sum((degree = 10)::INT)::BIGINT AS degree_10, sum((degree = 20)::INT)::BIGINT AS degree_20, sum((degree = 30)::INT)::BIGINT AS degree_30, 0 AS weighted FROM deg""")
query("total_weight", lambda s, d: stats.total_weight(part_supp_weighted(s, d)), f"SELECT sum(weight)::BIGINT AS total_weight FROM ({_PSW})")

# Validation.
query("loops", lambda s, d: validate.loops(part_mod(s, d)), f"SELECT * FROM ({_PM}) WHERE src = dst")
query("dup_edges", lambda s, d: validate.duplicates(part_mod(s, d)), f"SELECT src, dst, count(*) AS times FROM ({_PM}) GROUP BY ALL HAVING count(*) > 1")
query("missing_reverse", lambda s, d: validate.missing_reverse(part_mod(s, d)), f"WITH e AS ({_PM}) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")
query("missing_reverse_weighted", lambda s, d: validate.missing_reverse(part_mod(s, d).withColumn("weight", F.col("src") % 3)), f"WITH e AS (SELECT *, src % 3 AS weight FROM ({_PM})) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src AND f.weight = e.weight)")
query("outside", lambda s, d: validate.outside(part_mod(s, d), N // 2), f"SELECT * FROM ({_PM}) WHERE src >= {N // 2} OR dst >= {N // 2}")
query("bad_range", lambda s, d: validate.broken_ranges(s.sql("SELECT * FROM VALUES (0, 0L, 5L), (1, 5L, 4L), (2, 4L, 9L), (3, 8L, 9L) AS t(pe, first, last)")), "SELECT * FROM (VALUES (1, 5::BIGINT, 4::BIGINT, 5::BIGINT), (3, 8, 9, 9)) t(pe, first, last, expected)")
query("chkgraph", lambda s, d: validate.report(part_mod(s, d), N), f"""WITH e AS ({_PM}) SELECT 'outside' AS rule, count(*) AS broken FROM e WHERE src >= {N} OR dst >= {N} UNION ALL SELECT 'loops', count(*) FROM e WHERE src = dst
    UNION ALL SELECT 'duplicates', count(*) FROM (SELECT src FROM e GROUP BY src, dst HAVING count(*) > 1) UNION ALL SELECT 'missing_reverse', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)
    UNION ALL SELECT 'beyond_32_bits', 0""")

# Weights.
_PAIR = ("least(src, dst)", "greatest(src, dst)")
query("w_hash", lambda s, d: weights.hashed(part_mod(s, d), family="portable"), f"SELECT *, 1 + {sql_bits52(0, *_PAIR)} % 99 AS weight FROM ({_PM})")
query("w_uniform", lambda s, d: weights.uniform_edges(part_mod(s, d), 9, 5, 25, family="portable"), f"""SELECT *, 5 + {sql_bits52(9, "'e'", *_PAIR)} % 20 AS weight FROM ({_PM})""")
query("v_uniform", lambda s, d: weights.uniform_vertices(s.range(N), 9, family="portable"), f"""SELECT range AS id, 1 + {sql_bits52(9, "'v'", 'range')} % 99 AS weight FROM range({N})""")
query("w_voiding", lambda s, d: weights.voided(part_supp_weighted(s, d)), _PS)


# Generators, by the portable family.
def _both(rows: str) -> str:
    return f"WITH h AS ({rows}) SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h WHERE src <> dst"


def _grid(sides: tuple[int, ...], p: float = 1.0, periodic: bool = False, seed: int = 1) -> str:
    n, stride, parts = 1, 1, []
    for k in sides:
        n *= k
    for k in sides:
        at = f"(range // {stride}) % {k}"
        parts.append(f"SELECT range AS src, range + {stride} AS dst FROM range({n}) WHERE {at} < {k - 1}")
        if periodic and k > 2:
            parts.append(f"SELECT range AS src, range - {(k - 1) * stride} AS dst FROM range({n}) WHERE {at} = {k - 1}")
        stride *= k
    keep = f" WHERE {sql_uniform(seed, *_PAIR)} < {p}" if p < 1 else ""
    return _both(f"SELECT * FROM ({' UNION ALL '.join(parts)}){keep}")


for _name, _args in {"grid2d": ((30, 20),), "grid2d_p": ((40, 40), 0.4), "grid2d_torus": ((9, 7), 0.8, True), "grid3d": ((8, 9, 10), 0.7), "grid3d_torus": ((2, 5, 4), 1.0, True)}.items():
    query(_name, partial(lambda s, d, a: gen.lattice(s, *a, family="portable").edges, a=_args), _grid(*_args))
query("path", lambda s, d: gen.path(s, 500).edges, "SELECT range AS src, range + 1 AS dst FROM range(499)")
query("cycle", lambda s, d: gen.path(s, 500, periodic=True).edges, "SELECT range AS src, (range + 1) % 500 AS dst FROM range(500)")
query("path_permuted", lambda s, d: gen.path(s, 500, permute_seed=4, family="portable").edges, f"WITH p AS (SELECT range AS id, row_number() OVER (ORDER BY {sql_bits52(4, 'range')}, range) - 1 AS new FROM range(500)) SELECT a.new AS src, b.new AS dst FROM p a JOIN p b ON b.id = a.id + 1")
_CROSS = "SELECT a.range AS src, b.range AS dst FROM range(200) a, range(200) b"
query("gnp_directed", lambda s, d: gen.gnp(s, 200, 0.1, 3, True, family="portable").edges, f"SELECT * FROM ({_CROSS}) WHERE src <> dst AND {sql_uniform(3, 'src', 'dst')} < 0.1")
query("gnp_undirected", lambda s, d: gen.gnp(s, 200, 0.1, 3, family="portable").edges, _both(f"SELECT * FROM ({_CROSS}) WHERE src > dst AND {sql_uniform(3, 'src', 'dst')} < 0.1"))
query("gnm_directed", lambda s, d: gen.gnm(s, 100, 700, 3, True, family="portable").edges, f"SELECT range // 99 AS src, range % 99 + (range % 99 >= range // 99)::INT AS dst FROM (SELECT range FROM range(9900) ORDER BY {sql_bits52(3, 'range')}, range LIMIT 700)")
query("gnm_undirected", lambda s, d: gen.gnm(s, 100, 700, 3, family="portable").edges, _both(f"WITH t AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS cell FROM (SELECT a.range AS src, b.range AS dst FROM range(100) a, range(100) b WHERE a.range > b.range)) SELECT src, dst FROM t ORDER BY {sql_bits52(3, 'cell')}, cell LIMIT 700"))


def _levels(k: int, m: int, a: float, b: float, c: float, seed: int) -> str:
    u = ", ".join(f"{sql_uniform(seed, 'range', str(i))} AS u{i}" for i in range(k))
    src = " + ".join(f"CASE WHEN u{i} >= {a + b} THEN {1 << i} ELSE 0 END" for i in range(k))
    dst = " + ".join(f"CASE WHEN (u{i} >= {a} AND u{i} < {a + b}) OR u{i} >= {a + b + c} THEN {1 << i} ELSE 0 END" for i in range(k))
    return f"SELECT ({src})::BIGINT AS src, ({dst})::BIGINT AS dst FROM (SELECT {u} FROM range({m}))"


query("rmat", lambda s, d: gen.rmat(s, 1 << 9, 3000, 0.5, 0.25, 0.125, 5, family="portable").edges, f"WITH e AS ({_levels(9, 3000, 0.5, 0.25, 0.125, 5)}) {_SYM}")
query("rmat_directed", lambda s, d: gen.rmat(s, 1 << 9, 3000, 0.5, 0.25, 0.125, 5, directed=True, family="portable").edges, f"SELECT DISTINCT * FROM ({_levels(9, 3000, 0.5, 0.25, 0.125, 5)}) WHERE src <> dst")
query("kronecker", lambda s, d: gen.kronecker(s, 1 << 8, 2000, 6, family="portable").edges, f"WITH e AS (SELECT (src * 1664525 + 1013904223) % 256 AS src, (dst * 1664525 + 1013904223) % 256 AS dst FROM ({_levels(8, 2000, 0.25, 0.25, 0.25, 6)})) {_SYM}")


def _points(n: int, dims: int, seed: int) -> str:
    return "SELECT range AS id, " + ", ".join(f"{sql_uniform(seed, 'range', str(i))} AS {'xyz'[i]}" for i in range(dims)) + f" FROM range({n})"


def _near(n: int, dims: int, seed: int, r: float, extra: str = "") -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in "xyz"[:dims])
    return f"WITH p AS ({_points(n, dims, seed)}), h AS (SELECT a.id AS src, b.id AS dst, {d2} AS d2 FROM p a JOIN p b ON a.id < b.id WHERE {d2} <= {r}::DOUBLE * {r}::DOUBLE) SELECT src, dst{extra} FROM h UNION ALL SELECT dst, src{extra} FROM h"


query("rgg2d", lambda s, d: gen.rgg(s, 800, 0.07, 2, 7, "portable").edges, _near(800, 2, 7, 0.07))
query("rgg3d", lambda s, d: gen.rgg(s, 800, 0.15, 3, 7, "portable").edges, _near(800, 3, 7, 0.15))
query("rgg2d_weighted", lambda s, d: gen.rgg(s, 800, 0.07, 2, 7, "portable", (1, 100)).edges, _near(800, 2, 7, 0.07, ", least(99, 1 + floor(99 * sqrt(d2) / 0.07::DOUBLE))::BIGINT AS weight"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return gen.near_pairs(v, 0.05, ["x", "y"]).select("src", "dst")


query("embed_near", _embedded, "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05::DOUBLE * 0.05::DOUBLE")
_RHG_R, _RHG_A = 9.5, 0.75
query("rhg", lambda s, d: gen.rhg(s, 500, 2.5, _RHG_R, 11, "portable").edges, f"""WITH p AS (SELECT range AS id, 6.283185307179586 * {sql_uniform(11, 'range', "'phi'")} AS phi, acosh(1 + {sql_uniform(11, 'range', "'r'")} * (cosh({_RHG_A * _RHG_R}::DOUBLE) - 1)) / {_RHG_A} AS r FROM range(500)),
    h AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE cosh(a.r) * cosh(b.r) - sinh(a.r) * sinh(b.r) * cos(a.phi - b.phi) <= cosh({_RHG_R}::DOUBLE)) SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h""")
_DRAW = "(((({0} + 2) % 2147483647 * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647) % {0}"
query("ba", lambda s, d: gen.ba(s, 300, 3, 2, family="portable").edges, f"""WITH RECURSIVE w AS (SELECT range AS slot, (2 * range + 1)::BIGINT AS r FROM range(900) UNION ALL SELECT slot, ({_DRAW.format('r')})::BIGINT FROM w WHERE r % 2 = 1),
    e AS (SELECT slot // 3 AS src, r // 6 AS dst FROM w WHERE r % 2 = 0) SELECT src, dst FROM e UNION SELECT dst, src FROM e""")
query("rdg2d", lambda s, d: gen.rdg2d(s, 40, 3, "portable").edges, f"""WITH p AS ({_points(40, 2, 3)}), t AS (SELECT a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy,
    2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d FROM p a, p b, p c WHERE a.id < b.id AND b.id < c.id),
    o AS (SELECT *, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d AS ux, ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d AS uy FROM t),
    ok AS (SELECT i, j, k FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id NOT IN (i, j, k) AND (p.x - ux) * (p.x - ux) + (p.y - uy) * (p.y - uy) < (ax - ux) * (ax - ux) + (ay - uy) * (ay - uy))),
    h AS (SELECT i AS src, j AS dst FROM ok UNION SELECT j, k FROM ok UNION SELECT i, k FROM ok) SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h""")


def _pixels(spark: SparkSession, side: int = 16) -> DataFrame:
    r, c = F.expr(f"id div {side}"), F.col("id") % side
    channel = lambda k: (bits52(8, F.col("id"), F.lit(k), family="portable") % 256).cast("smallint").alias("rgb"[k])
    return spark.range(side * side).select(r.alias("row"), c.alias("col"), *map(channel, range(3)))


def _image(neighborhood: int, model: str) -> str:
    offsets = ", ".join(f"({i}, {j})" for i, j in gen._offsets(neighborhood))
    weight = {"l2": "sqrt((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b))", "inv-ratio": " * ".join(f"(least(a.{c}, b.{c}) + 1)::DOUBLE / (greatest(a.{c}, b.{c}) + 1)" for c in "rgb")}[model]
    scale = 1.0 if model == "l2" else 255.0
    return f"""WITH p AS (SELECT range // 16 AS row, range % 16 AS col, {', '.join(f"({sql_bits52(8, 'range', str(k))} % 256)::DOUBLE AS {'rgb'[k]}" for k in range(3))} FROM range(256)), o(i, j) AS (VALUES {offsets}),
    h AS (SELECT a.row * 16 + a.col AS src, b.row * 16 + b.col AS dst, floor({weight} * {scale})::BIGINT AS weight FROM p a, o JOIN p b ON b.row = a.row + o.i AND b.col = a.col + o.j)
    SELECT src, dst, weight FROM h WHERE weight >= 1 UNION ALL SELECT dst, src, weight FROM h WHERE weight >= 1"""


for _k, _m in ((4, "l2"), (8, "inv-ratio"), (20, "l2"), (24, "l2")):
    query(f"image_mesh_{_k}", partial(lambda s, d, k, m: gen.image_mesh(_pixels(s), 16, 16, m, 1.0 if m == "l2" else 255.0, neighborhood=k).edges, k=_k, m=_m), _image(_k, _m))

# Scalars.
query("scalars", lambda s, d: s.range(1, N).select("id", bit_length(F.col("id")).cast("int").alias("bits"), uniform(1, F.col("id"), family="portable").alias("u"), *[c.alias(k) for c, k in zip(gen.from_triangle(F.col("id")), ("row", "col"), strict=True)]),
      f"WITH t AS (SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS id, a.range AS row, b.range AS col FROM range(80) a, range(80) b WHERE a.range > b.range) SELECT id, {_BITS.format('id')}::INT AS bits, {sql_uniform(1, 'id')} AS u, row, col FROM t WHERE id BETWEEN 1 AND {N - 1}")
query("cust_order_stars", lambda s, d: stats.degree_bins(transforms.symmetrize(cust_order(s, d))), f"WITH e AS (SELECT o_custkey AS src, o_orderkey + {OFF} AS dst FROM orders), g AS ({_SYM}), d AS (SELECT src, count(*) AS c FROM g GROUP BY src) SELECT {_BITS.format('c')}::INT AS bin, count(*) AS vertices FROM d GROUP BY ALL")


# What the queries above run of the generators is the portable family, which SQL can repeat; these run the native one, at
# sizes where ids and cells pass 2^31 and 2^53, and hold its graphs to their properties.


def properties(edges: DataFrame, n: int, undirected: bool) -> DataFrame:
    """A row: whether edges are distinct, inside [0, n), without loops and, if undirected, both ways; their number; and whether
    the ends are spread evenly over n and over odd and even."""
    ways = validate.missing_reverse(edges).agg(F.count(F.lit(1)).alias("one_way")) if undirected else edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("one_way"))
    half, odd = F.avg(F.col("dst") / F.lit(float(n))), F.avg(F.pmod(F.col("dst"), F.lit(2)))
    row = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).agg(
        F.sum("times").cast("long").alias("edges"), F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).cast("long").alias("loops"),
        F.sum(F.when((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n) | (F.col("dst") >= n), 1).otherwise(0)).cast("long").alias("outside"),
        (F.abs(odd - 0.5) < 0.05).alias("even_parity"), (F.abs(half - 0.5) < 0.05).alias("even_spread"),
    )
    return row.crossJoin(F.broadcast(ways))  # one row each


def _property_sql(edges: str) -> str:
    return f"SELECT ({edges})::BIGINT AS edges, ({edges})::BIGINT AS pairs, 0::BIGINT AS loops, 0::BIGINT AS outside, true AS even_parity, true AS even_spread, 0::BIGINT AS one_way"


query("native_gnm_undirected", lambda s, d: properties(gen.gnm(s, 1 << 31, 20_000, 5).edges, 1 << 31, True), _property_sql("40000"))
query("native_gnm_directed", lambda s, d: properties(gen.gnm(s, (1 << 31) - 1, 20_000, 5, directed=True).edges, (1 << 31) - 1, False), _property_sql("20000"))
query("native_path", lambda s, d: properties(gen.path(s, 20_001, permute_seed=3).edges, 20_001, False), _property_sql("20000"))
query("native_grid2d", lambda s, d: properties(gen.lattice(s, (120, 170)).edges, 120 * 170, True), _property_sql("2 * (119 * 170 + 120 * 169)"))
query("native_gnp", lambda s, d: properties(gen.gnp(s, 1 << 31, 1e-14, 5).edges, 1 << 31, True).select(F.col("edges") == F.col("pairs"), "loops", "outside", "one_way", (F.abs(F.col("edges") - 46_117) < 1_300).alias("near_mean")).toDF("distinct_pairs", "loops", "outside", "one_way", "near_mean"), "SELECT true AS distinct_pairs, 0::BIGINT AS loops, 0::BIGINT AS outside, 0::BIGINT AS one_way, true AS near_mean")
query("native_ba", lambda s, d: stats.degrees(gen.ba(s, 30_000, 4, 7, directed=True).edges, 30_000).agg((F.max("degree") <= 4).alias("at_most_d"), (F.avg("degree") > 3.9).alias("mostly_d")), "SELECT true AS at_most_d, true AS mostly_d")
query("triangle_cells", lambda s, d: _cells(s), "SELECT 60001::BIGINT AS cells, 60001::BIGINT AS pairs, 60001::BIGINT AS restored")


def _cells(spark: SparkSession) -> DataFrame:
    """Cells of the triangle at its begin, about 2^53 and below 2^62: each has a pair of its own, whose number it is."""
    begins = [0, (1 << 53) - 10_000, (1 << 54), (1 << 61) - 1, (1 << 61) + (1 << 60), (1 << 62) - 10_001]
    k = reduce(DataFrame.unionAll, [spark.range(b, b + 10_000 + (b == 0)) for b in begins]).withColumnRenamed("id", "k")
    row, col = from_triangle(F.col("k"))
    pairs = k.select("k", row.alias("r"), col.alias("c")).where("c >= 0 and c < r")
    whole = pairs.withColumn("again", below(F.col("r")) + F.col("c"))
    return whole.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("r", "c").alias("pairs"), F.sum(F.when(F.col("again") == F.col("k"), 1).otherwise(0)).cast("long").alias("restored"))


def _converted(spark: SparkSession, sf_dir: str) -> Graph:
    g = Graph(part_mod(spark, sf_dir).withColumn("weight", F.lit(1).cast("long")), N, directed=True)
    return tools.converted(g, drop_weights=True, add_reverse=True, drop_loops=True, sort=True, degree_weights=True, isolated=7)


query("convert_edges", lambda s, d: _converted(s, d).edges, f"WITH e AS ({_PM}) {_SYM}")
query("convert_vertices", lambda s, d: _converted(s, d).points, f"WITH e AS ({_PM}), s AS ({_SYM}) SELECT range AS id, CASE WHEN count(src) = 0 THEN 7 ELSE count(src) END::BIGINT AS weight FROM range({N}) LEFT JOIN s ON range = src GROUP BY 1")
query("graph_statistics", lambda s, d: tools.statistics(_converted(s, d)).select("n", "m", "edge_weights", "vertex_weights", F.posexplode("bins").alias("bin", "vertices")).where("vertices > 0"), f"""WITH e AS ({_PM}), s AS ({_SYM}), d AS (SELECT range AS id, count(src) AS degree FROM range({N}) LEFT JOIN s ON range = src GROUP BY 1)
SELECT {N}::BIGINT AS n, (SELECT count(*) FROM s) AS m, 0 AS edge_weights, 1 AS vertex_weights, CASE WHEN degree = 0 THEN 0 ELSE floor(log2(degree))::INT + 1 END AS bin, count(*) AS vertices FROM d GROUP BY ALL""")
query("graph_check", lambda s, d: tools.checked(_converted(s, d)), "SELECT unnest(['outside', 'loops', 'duplicates', 'missing_reverse', 'beyond_32_bits', 'vertex_weights']) AS rule, 0::BIGINT AS broken")
_NETS = f"WITH e AS ({_PM}), s AS (SELECT * FROM ({_SYM}) WHERE src < 300 AND dst < 300), k AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM s WHERE src < dst)"
query("freight_netl", lambda s, d: _netl(s, d, "freight-netl"), f"""{_NETS} SELECT range AS a, concat_ws(' ', '1', string_agg(k.k || ' 1', ' ' ORDER BY s.dst)) AS value FROM range(300) LEFT JOIN s ON range = s.src LEFT JOIN k ON least(s.src, s.dst) = k.src AND greatest(s.src, s.dst) = k.dst GROUP BY 1
UNION ALL SELECT -1, '300 ' || (SELECT count(*) FROM s) // 2 || ' 11'""")
query("freight_netl_ep", lambda s, d: _netl(s, d, "freight-netl-ep"), f"{_NETS} SELECT src AS a, '1 ' || src || ' 1 ' || dst || ' 1' AS value FROM k UNION ALL SELECT -1, (SELECT count(*) FROM k) || ' 300 11'")


def _netl(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    e = transforms.symmetrize(part_mod(spark, sf_dir)).where("src < 300 and dst < 300")
    return sources.lines_of(Graph(e, 300), fmt).toDF("a", "b", "value").select("a", "value")
