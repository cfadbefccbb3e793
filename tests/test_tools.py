"""The command line and tools, exact arithmetic, streams of all vertices."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom import api, cli, sources, streaming, tools
from vertexloom.functions import below, from_triangle
from vertexloom.graph import Graph
from vertexloom.operators import generators as gen
from vertexloom.operators import transforms


@pytest.mark.parametrize("begin", [0, (1 << 53) - 500, (1 << 61) - 500, (1 << 62) - 1001])
def test_triangle_cells(spark, begin):
    row, col = from_triangle(F.col("id"))
    rows = spark.range(begin, begin + 1000).select("id", row.alias("r"), col.alias("c")).collect()
    assert all(r["r"] * (r["r"] - 1) // 2 + r["c"] == r["id"] and 0 <= r["c"] < r["r"] for r in rows)
    assert spark.range(5).select(below(F.col("id") + 1)).collect() == [(0,), (1,), (3,), (6,), (10,)]


@pytest.mark.parametrize("n", [1 << 53, (1 << 61) + 3])
def test_owner_and_running_of_large_ids(spark, n):
    v = [0, n // 3, n // 3 + 1, n - 2, n - 1, n, -1]
    q, r = divmod(n, 3)
    first = [p * q + min(p, r) for p in range(4)]
    want = [next((p for p in range(3) if first[p] <= x < first[p + 1]), -1) for x in v]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    assert [x[0] for x in df.select(transforms.owner(F.col("v"), n, 3)).collect()] == want
    rows = transforms.running(df.where("v >= 0").withColumn("one", F.lit(1)), "v", "one", "k").orderBy("v").collect()
    assert [x["k"] for x in rows] == list(range(6))


def test_draws_are_spread():
    r = np.arange(100_001, 2_000_001, 19, dtype=np.int64) * 1_000_003
    share = gen._mixed_draws(r, 3) / r
    assert share.max() > 0.999 and abs(share.mean() - 0.5) < 0.01 and len(np.unique(gen._mixed_draws(r, 3))) > 0.99 * len(r)


def test_native_ba_walks_to_even_slots(spark):
    e = gen.ba(spark, 500, 3, 1, directed=True).edges
    assert e.where("dst > src or dst < 0").isEmpty() and e.groupBy("src").count().agg(F.max("count")).first()[0] <= 3


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "g.metis")
    assert cli.main(["generate", "gnm_undirected;n=50;m=120;seed=4", "-o", path], spark) == 0
    assert cli.main(["check", path], spark) == 0
    capsys.readouterr()
    assert cli.main(["stats", path], spark) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["n"], row["m"]) == (50, 240) and sum(row["bins"]) == 50 and len(row["bins"]) == 65
    out = str(tmp_path / "h.metis")
    assert cli.main(["convert", path, out, "--degree-weights", "--isolated", "9"], spark) == 0
    weights = {r["id"]: r["weight"] for r in sources.read_graph(spark, out).points.collect()}
    degree = dict(sources.read_graph(spark, path).edges.groupBy("src").count().collect())
    assert weights == {i: degree.get(i, 9) for i in range(50)}
    broken = str(tmp_path / "b.plain-edgelist")
    sources.write_graph(Graph(spark.createDataFrame([(0, 0), (0, 1)], "src long, dst long"), 2), broken)
    assert cli.main(["check", broken], spark) == 1
    assert cli.main(["describe", "rgg2d;n=1000;m=4000"]) == 0


def test_generator_methods(spark):
    a = api.Generators(spark, seed=5).gnm_undirected(n=60, m=100)
    b = api.generate(spark, "gnm_undirected;n=60;m=100;seed=5")
    assert sorted(a.edges.collect()) == sorted(b.edges.collect())
    with pytest.raises(AttributeError):
        api.Generators(spark).nothing
    assert api.describe("gnm_undirected;n=60;m=100").m == 100


def test_freight_formats(spark):
    e = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (1, 2, 7), (2, 1, 7)], "src long, dst long, weight long")
    text = lambda g, f: [r["value"] for r in sources.lines_of(g, f).toDF("a", "b", "value").orderBy("a", "b").collect()]
    assert text(Graph(e, 4), "freight-netl") == ["4 2 11", "1 1 5", "1 1 5 2 7", "1 2 7", "1"]
    assert text(Graph(e, 4), "freight-netl-ep") == ["2 4 11", "1 0 1 1 1", "1 1 1 2 1"]
    assert text(Graph(e, 4), "hmetis") == ["2 4 1", "5 1 2", "7 2 3"]


def test_thresholds_before_the_floor(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 1, 1, 0)], "row long, col long, r int, g int, b int")
    of = lambda high: gen.image_mesh(pixels, 2, 1, "l2", 1.0, high=high).edges.count()
    assert of(1.0) == 0 and of(1.5) == 2  # the weight is the root of two


def test_streams_have_all_vertices(spark, tmp_path):
    g = Graph(spark.createDataFrame([(0, 1), (1, 0), (7, 8), (8, 7)], "src long, dst long"), 12)
    streaming.spool(g, f"{tmp_path}/s", 4)
    got = []
    streaming.for_each_node(spark, f"{tmp_path}/s", lambda df, i: got.extend(map(tuple, df.collect())), f"{tmp_path}/c", 12, 4)
    assert sorted(got) == sorted((i, {0: [1], 1: [0], 7: [8], 8: [7]}.get(i, [])) for i in range(12))


def test_conversion_steps(spark):
    g = Graph(spark.createDataFrame([(0, 1, 4), (1, 1, 2)], "src long, dst long, weight long"), 3, directed=True)
    out = tools.converted(g, True, True, True, True, True)
    assert out.edges.collect() == [(0, 1), (1, 0)] and dict(out.points.collect()) == {0: 1, 1: 1, 2: 0}
    assert {r["rule"]: r["broken"] for r in tools.checked(g).collect()}["loops"] == 1
