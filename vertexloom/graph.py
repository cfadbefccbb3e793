"""A graph: its edges, its vertices where they have columns beside the id, and its number of vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n: int
    points: DataFrame | None = None
    directed: bool = False

    @property
    def vertices(self) -> DataFrame:
        return self.points if self.points is not None else self.edges.sparkSession.range(self.n)
