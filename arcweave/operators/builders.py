"""Checked construction of small graphs, and regular topologies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import InvalidArgument
from ..graph import Graph
from . import generators as gen


@dataclass
class GraphBuilder:
    """Collects nodes and edges by position; ``build`` checks them."""

    directed: bool = False
    self_loops: bool = True
    parallel_edges: bool = True
    nodes: list = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)

    def allow_self_loops(self, allow: bool) -> GraphBuilder:
        self.self_loops = allow
        return self

    def allow_parallel_edges(self, allow: bool) -> GraphBuilder:
        self.parallel_edges = allow
        return self

    def add_node(self, attr) -> GraphBuilder:
        self.nodes.append(attr)
        return self

    def add_nodes(self, attrs) -> GraphBuilder:
        self.nodes.extend(attrs)
        return self

    def add_edge(self, u: int, v: int, weight: float = 1.0) -> GraphBuilder:
        self.edges.append((u, v, weight))
        return self

    def add_edges(self, edges) -> GraphBuilder:
        self.edges.extend(edges)
        return self

    def validate(self) -> None:
        """Raises if an edge names a node that isn't there."""
        for e in self.edges:
            if not all(0 <= x < len(self.nodes) for x in e[:2]):
                raise InvalidArgument(f"edge {e[:2]} names an unknown node")

    def build(self, spark: SparkSession) -> Graph:
        self.validate()
        seen = set()
        for u, v, *_ in self.edges:
            if u == v and not self.self_loops:
                raise InvalidArgument(f"self-loop at {u}")
            key = (u, v) if self.directed else (min(u, v), max(u, v))
            if key in seen and not self.parallel_edges:
                raise InvalidArgument(f"parallel edge {key}")
            seen.add(key)
        return Graph.from_lists(spark, list(enumerate(self.nodes)), self.edges, self.directed)


class TopologyBuilder:
    """Undirected regular graphs with one attribute and one weight throughout."""

    @staticmethod
    def complete(spark: SparkSession, n: int, attr: int = 0, weight: float = 1.0) -> Graph:
        g = gen.complete_graph(spark, n) if n else Graph.empty(spark)
        return g.map_node_attrs(f"cast({attr} as long)").map_edge_weights(f"cast({weight} as double)")

    @staticmethod
    def cycle(spark: SparkSession, n: int, attr: int = 0, weight: float = 1.0) -> Graph:
        """One vertex gives a self-loop, two a pair of parallel edges."""
        return gen.cycle_graph(spark, n, least=1, attr=attr, weight=weight) if n else Graph.empty(spark)

    @staticmethod
    def path(spark: SparkSession, n: int, attr: int = 0, weight: float = 1.0) -> Graph:
        return gen.path_graph(spark, n, attr=attr, weight=weight) if n else Graph.empty(spark)

    @staticmethod
    def star(spark: SparkSession, n: int, attr: int = 0, weight: float = 1.0) -> Graph:
        return gen.star_graph(spark, n, attr=attr, weight=weight) if n else Graph.empty(spark)

    @staticmethod
    def grid(spark: SparkSession, rows: int, cols: int, attr: int = 0, weight: float = 1.0) -> Graph:
        return gen.grid_graph(spark, rows, cols, attr, weight) if rows and cols else Graph.empty(spark)
