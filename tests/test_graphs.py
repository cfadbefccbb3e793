import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom import api, sources, streaming
from vertexloom.graph import Graph
from vertexloom.operators import generators as gen
from vertexloom.operators import transforms, validate
from vertexloom.permutation import permuted
from vertexloom.spec import normalized, parse


def edges(df):
    return sorted(map(tuple, df.select("src", "dst").collect()))


def test_option_string():
    s = parse("gnm-undirected;N=10;m=16;seed=3".replace("gnm-undirected", "gnm_undirected"))
    assert (s.model, s.n, s.m, s.seed) == ("gnm_undirected", 1024, 16, 3)
    assert parse("type=rgg2d;n=5;radius=0.5;coordinates").coordinates
    for bad in ("n=4", "gnm_undirected;zzz=1", "type=zzz"):
        with pytest.raises(ValueError):
            parse(bad)


@pytest.mark.parametrize("options", ["gnm_undirected;n=4;m=7", "gnp_directed;n=4;p=2", "rgg2d;n=4", "rhg;n=4;d=2;gamma=2", "rmat;n=8;m=4;a=0.9;b=0.2", "grid2d;x=2;y=2;m=9"])
def test_contradictions(options):
    with pytest.raises(ValueError):
        normalized(parse(options))


def test_deduction():
    assert normalized(parse("rmat;n=1000;m=5;a=0.5;b=0.2;c=0.1")).n == 512
    s = normalized(parse("rgg2d;n=1000;m=4000"))
    assert abs(1000 * 999 * s.r**2 * (s.r**2 / 2 - 8 * s.r / 3 + np.pi) - 8000) < 1e-3
    s = normalized(parse("grid2d;x=10;y=10;m=90"))
    assert abs(s.p - 0.5) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation(n):
    x = np.arange(n)
    y = permuted(x, n, 5)
    assert sorted(y) == list(x)
    assert (permuted(y, n, 5, back=True) == x).all()


@pytest.mark.parametrize("directed,loops", [(False, False), (False, True), (True, False), (True, True)])
def test_gnm(spark, directed, loops):
    g = gen.gnm(spark, 50, 300, 9, directed, loops)
    e = edges(g.edges)
    assert len(e) == len(set(e))
    assert directed and len(e) == 300 or not directed and len({tuple(sorted(x)) for x in e}) == 300
    assert loops or all(a != b for a, b in e)
    assert directed or {(b, a) for a, b in e} == set(e)
    assert all(0 <= a < 50 and 0 <= b < 50 for a, b in e)


def test_gnm_whole(spark):
    assert len(edges(gen.gnm(spark, 10, 45).edges)) == 90


@pytest.mark.parametrize("options", ["gnm_undirected;n=200;m=900", "gnp_undirected;n=100;p=0.1", "rgg2d;n=300;m=900", "rgg3d;n=300;m=900", "rhg;n=300;avg_degree=6;gamma=2.8", "ba;n=200;min_degree=3", "grid2d;x=6;y=7;periodic", "grid3d;x=3;y=4;z=5", "rmat;n=128;m=500;a=0.5;b=0.2;c=0.2", "kronecker;n=128;m=500", "rdg2d;n=60"])
def test_models_are_valid_and_repeatable(spark, options):
    g = api.generate(spark, options + ";seed=4")
    assert validate.is_valid(g.edges, g.n, allow_loops="ba" in options)
    e = edges(g.edges)
    assert e
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert edges(api.generate(spark, options + ";seed=4").edges) == e
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_rgg_against_all_pairs(spark):
    g = gen.rgg(spark, 200, 0.1, seed=3)
    pts = {r["id"]: (r["x"], r["y"]) for r in g.points.collect()}
    want = sorted((a, b) for a in pts for b in pts if a != b and (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= 0.1 * 0.1)
    assert edges(g.edges) == want


def test_weights_and_permutation(spark):
    g = api.generate(spark, "gnm_undirected;n=100;m=400;edgeweights_generator=uniform_random;vertexweights_generator=uniform_random;permute")
    assert validate.missing_reverse(g.edges).isEmpty()
    low, high = g.edges.agg(F.min("weight"), F.max("weight")).first()
    assert 1 <= low <= high < 100
    plain = api.generate(spark, "gnm_undirected;n=100;m=400")
    assert edges(transforms.permute(g.edges, g.n, 1, back=True)) == edges(plain.edges)


def test_validation_finds_faults(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 4), (3, 4), (9, 1)], "src long, dst long")
    found = {r["rule"]: r["broken"] for r in validate.report(e, 5).collect()}
    assert found == {"outside": 1, "loops": 1, "duplicates": 1, "missing_reverse": 3, "beyond_32_bits": 0}


def test_empty(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert edges(transforms.symmetrize(e)) == []
    assert transforms.max_id(e).first()["n"] == 0
    assert validate.is_valid(e, 0)


METIS = {"3 3\n2 3\n1 3\n1 2": 6, "% c\n2 1\n% c\n2\n%\n1": 2, " \n": 0, "3 1\n2\n1\n": 2}


@pytest.mark.parametrize("text", METIS)
def test_metis(spark, tmp_path, text):
    (tmp_path / "g.metis").write_text(text)
    assert len(edges(sources.read_graph(spark, str(tmp_path / "g.metis")).edges)) == METIS[text]


def test_weighted_metis(spark, tmp_path):
    (tmp_path / "g.metis").write_text("3 3 011\n10 2 1 3 2\n20 1 1 3 3\n30 1 2 2 3\n")
    g = sources.read_graph(spark, str(tmp_path / "g.metis"))
    assert {tuple(r) for r in g.edges.collect()} == {(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 3), (2, 0, 2), (2, 1, 3)}
    assert {tuple(r) for r in g.points.collect()} == {(0, 10), (1, 20), (2, 30)}


@pytest.mark.parametrize("fmt", ["metis", "parhip", "plain-edgelist", "weighted-binary-edgelist"])
def test_round_trips(spark, tmp_path, fmt):
    g = api.generate(spark, "gnm_undirected;n=60;m=200;edgeweights_generator=hashing_based")
    path = str(tmp_path / f"g.{fmt}")
    sources.write_graph(g, path, fmt)
    back = sources.read_graph(spark, path, fmt)
    assert edges(back.edges) == edges(g.edges)
    if "weight" in back.edges.columns:
        assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.select(*back.edges.columns).collect()))


@pytest.mark.parametrize("fmt,want", [
    ("edgelist", "p 3 4\ne 1 2\ne 2 1\ne 2 3\ne 3 2\n"), ("edgelist-undirected", "p 3 4\ne 1 2\ne 2 3\n"), ("hmetis", "2 3\n1 2\n2 3\n"), ("hmetis-directed", "4 3\n1 2\n2 1\n2 3\n3 2\n"),
    ("hmetis-ep", "3 2\n1\n1 2\n2\n"), ("dot", "graph G {\n1--2\n2--3\n}\n"), ("metis", "3 2\n2\n1 3\n2\n"), ("plain-edgelist", "0\t1\n1\t0\n1\t2\n2\t1\n"),
])
def test_text_formats(spark, tmp_path, fmt, want):
    g = Graph(spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long"), 3)
    sources.write_graph(g, str(tmp_path / "out"), fmt)
    assert (tmp_path / "out").read_text() == want


def test_checkerboard(spark, tmp_path):
    px = spark.range(256).select(F.expr("id div 16").alias("row"), (F.col("id") % 16).alias("col"))
    even = (F.expr("row div 2") + F.expr("col div 2")) % 2 == 0
    px = px.select("row", "col", F.when(even, 0).otherwise(255).alias("r"), F.when(even, 255).otherwise(0).alias("g"), F.lit(0).alias("b"))
    sources.write_kargb(px, 16, 16, str(tmp_path / "x.kargb"))
    g = api.generate(spark, f"image;filename={tmp_path}/x.kargb;weight_model=l2;weight_multiplier=1")
    assert g.n == 256 and g.edges.count() == 448
    assert {r["weight"] for r in g.edges.select("weight").collect()} == {360}


def test_stream(spark, tmp_path):
    g = gen.gnm(spark, 80, 300)
    streaming.spool(g, str(tmp_path / "s"), 4)
    got = []
    streaming.for_each_edge(spark, str(tmp_path / "s"), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "c"), only_ordered=True)
    assert sorted(got) == [x for x in edges(g.edges) if x[1] < x[0]]


def test_delaunay_circles():
    pts = np.random.default_rng(1).random((30, 2))
    e = gen.delaunay(pts)
    assert len(e) <= 3 * 30 - 6
    # Each point's nearest neighbour is one of its Delaunay neighbours.
    near = {tuple(sorted((i, int(np.argsort(((pts - pts[i]) ** 2).sum(1))[1])))) for i in range(30)}
    assert near <= set(map(tuple, e))
