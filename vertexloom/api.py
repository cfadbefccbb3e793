"""Graphs by option string or by name: deduction of parameters, generation, weights, permutation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .graph import Graph
from .operators import generators as gen
from .operators import transforms, weights
from .spec import MODELS, Spec, normalized, parse


def generate(spark: SparkSession, options: str | Spec) -> Graph:
    s = normalized(parse(options) if isinstance(options, str) else options)
    makers = {
        "gnm_undirected": lambda: gen.gnm(spark, s.n, s.m, s.seed, False, s.self_loops), "gnm_directed": lambda: gen.gnm(spark, s.n, s.m, s.seed, True, s.self_loops),
        "gnp_undirected": lambda: gen.gnp(spark, s.n, s.p, s.seed, False, s.self_loops), "gnp_directed": lambda: gen.gnp(spark, s.n, s.p, s.seed, True, s.self_loops),
        "rgg2d": lambda: gen.rgg(spark, s.n, s.r, 2, s.seed, weights=_distance(s)), "rgg3d": lambda: gen.rgg(spark, s.n, s.r, 3, s.seed, weights=_distance(s)),
        "rdg2d": lambda: gen.rdg2d(spark, s.n, s.seed), "rhg": lambda: gen.rhg(spark, s.n, s.g, s.r, s.seed), "ba": lambda: gen.ba(spark, s.n, int(s.d), s.seed, s.directed),
        "grid2d": lambda: gen.lattice(spark, (s.x, s.y), s.p, s.periodic, s.seed), "grid3d": lambda: gen.lattice(spark, (s.x, s.y, s.z), s.p, s.periodic, s.seed),
        "path": lambda: gen.path(spark, s.n, s.periodic, s.seed if s.permute else None), "rmat": lambda: gen.rmat(spark, s.n, s.m, s.a, s.b, s.c, s.seed, s.directed, s.self_loops),
        "kronecker": lambda: gen.kronecker(spark, s.n, s.m, s.seed, s.directed, s.self_loops), "file": lambda: sources.read_graph(spark, s.filename, s.input_format or None), "image": lambda: _image(spark, s),
    }
    if s.model not in makers:
        raise NotImplementedError(f"{s.model} is not built yet")
    g = makers[s.model]()
    e = weights.weighted_edges(g.edges, s.edgeweights_generator, s.seed, s.edgeweights_range_begin, s.edgeweights_range_end)
    points = g.points
    if s.vertexweights_generator == "uniform_random":
        points = weights.uniform_vertices(g.vertices, s.seed, s.vertexweights_range_begin, s.vertexweights_range_end)
    elif s.vertexweights_generator == "voiding" and points is not None:
        points = points.drop("weight")
    if s.permute and s.model != "path":
        e = transforms.permute(e, g.n, s.seed)
        points = None if points is None else transforms.permute(points, g.n, s.seed, ("id",))
    return replace(g, edges=e, points=points)


def describe(options: str | Spec) -> Spec:
    """The specification with what is deduced: all that a generation depends on."""
    return normalized(parse(options) if isinstance(options, str) else options)


class Generators:
    """A method for each model: Generators(spark, seed=3).gnm_undirected(n=100, m=400). Options given here hold for all calls."""

    def __init__(self, spark: SparkSession, **options: object):
        self.spark, self.options = spark, options

    def __getattr__(self, model: str):
        if model not in MODELS:
            raise AttributeError(model)
        said = lambda options: ";".join([model, *[f"{k}={int(v) if isinstance(v, bool) else v}" for k, v in options.items()]])
        return lambda **options: generate(self.spark, said(self.options | options))

    def from_options(self, options: str) -> Graph:
        return generate(self.spark, options)

    def read(self, path: str, input_format: str | None = None) -> Graph:
        return sources.read_graph(self.spark, path, input_format)


def _distance(s: Spec) -> tuple[int, int] | None:
    return (s.edgeweights_range_begin, s.edgeweights_range_end) if s.edgeweights_generator == "euclidean_distance" else None


def _image(spark: SparkSession, s: Spec) -> Graph:
    pixels = sources.read_kargb(spark, s.filename)
    rows, cols = pixels.agg(F.max("row") + 1, F.max("col") + 1).first()
    return gen.image_mesh(pixels, cols, rows, s.weight_model, s.weight_multiplier, s.weight_offset, s.min_weight_threshold, s.max_weight_threshold, s.neighborhood)
