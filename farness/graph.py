"""Graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices (id) and edges (src, dst and, if weighted, weight). Isolated vertices are rows of vertices without an edge.

    Ids are of one type that Spark can compare; weights are not negative. ends says that the vertices are just the ends of the edges.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    ends: bool = False

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def canonical(self) -> Graph:
        """Without loops, parallel edges and edges with a null end; undirected edges have src < dst, parallel ones the least weight."""
        e = self.edges.where("src <> dst")
        if not self.directed:
            e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *(["weight"] * self.weighted))
        e = e.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if self.weighted else e.distinct()
        return Graph(self.vertices.select("id").where("id IS NOT NULL").distinct(), e, self.directed)

    def arcs(self) -> DataFrame:
        """Edges in the directions they can be taken: both for an undirected graph."""
        if self.directed:
            return self.edges
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] * self.weighted))
        return self.edges.unionByName(back)

    def reversed(self) -> Graph:
        e = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] * self.weighted))
        return Graph(self.vertices, e, self.directed)

    @staticmethod
    def of_edges(edges: DataFrame, directed: bool = False) -> Graph:
        """The vertices are the ends of the edges."""
        return Graph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, directed, True)
