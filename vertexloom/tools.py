"""What the command line offers on graphs: conversion, statistics and checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .operators import stats, transforms, validate


def converted(g: Graph, drop_weights: bool = False, add_reverse: bool = False, drop_loops: bool = False, sort: bool = False, degree_weights: bool = False, isolated: int = 0) -> Graph:
    """A graph through the steps of a conversion, in this order. isolated: the weight by degree of vertices without edges."""
    e, points = g.edges, g.points
    if drop_weights:
        e, points = transforms.drop_weights(e), None if points is None else points.drop("weight")
    if add_reverse:
        e = transforms.symmetrize(e, keep_loops=True)
    if drop_loops:
        e = transforms.drop_loops(e)
    if sort:
        e = transforms.sorted_edges(e)
    if degree_weights:
        vertices = g.vertices.drop("weight") if points is not None else g.vertices
        points = vertices.join(transforms.weigh_by_degree(e, vertices.select("id"), isolated), "id")
    return replace(g, edges=e, points=points, directed=g.directed and not add_reverse)


def statistics(g: Graph, chosen: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """A row: counts, degrees, chosen degrees, which weights there are, and how many vertices fall into each of 65 bins of degree."""
    own = g.points is not None and "weight" in g.points.columns
    bins = stats.degree_bins(g.edges, g.n).agg(F.map_from_entries(F.collect_list(F.struct("bin", "vertices"))).alias("_b"))  # 65 entries at most
    buckets = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.coalesce(F.try_element_at("_b", i), F.lit(0).cast("long")))
    row = stats.graph_stats(g.edges, g.n, chosen).withColumnRenamed("weighted", "edge_weights").withColumn("vertex_weights", F.lit(int(own)))
    return row.crossJoin(F.broadcast(bins)).withColumn("bins", buckets).drop("_b")  # a row each


def checked(g: Graph, allow_loops: bool = False, allow_multi: bool = False) -> DataFrame:
    """rule, broken: all rules of validate.report, and those on vertex weights and 32-bit weights."""
    out = validate.report(g.edges, g.n, g.directed, allow_loops, allow_multi)
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("broken"))
    if "weight" in g.edges.columns:
        out = out.unionAll(count(g.edges.where(F.col("weight") >= 1 << 31), "weights_beyond_32_bits"))
    if g.points is not None and "weight" in g.points.columns:
        out = out.unionAll(count(g.points.where("weight < 0 or weight is null"), "vertex_weights"))
    return out
