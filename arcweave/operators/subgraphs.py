"""Parts of a graph; original ids stay (``Graph.relabel`` renumbers)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NodeNotFound
from ..graph import Expr, Graph, column
from .traversal import reachable


def subgraph(graph: Graph, nodes: Iterable[int] | DataFrame) -> Graph:
    """Induced by the nodes; raises if one is unknown."""
    ids = nodes.select("id").distinct() if isinstance(nodes, DataFrame) else graph.spark.createDataFrame([(n,) for n in set(nodes)], "id long")
    lost = ids.join(graph.vertices, "id", "left_anti").first()
    if lost is not None:
        raise NodeNotFound(lost[0])
    return graph.induced(graph.vertices.join(ids, "id", "left_semi"))


induced_subgraph = subgraph


def ego_graph(graph: Graph, center: int, radius: int) -> Graph:
    """Induced by what lies within ``radius`` hops; raises for an unknown centre."""
    graph.require_nodes(center)
    return graph.induced(graph.vertices.join(reachable(graph, center, radius), "id", "left_semi"))


def filter_nodes(graph: Graph, keep: Expr) -> Graph:
    """Induced by the nodes where the condition over the vertex columns holds (null: not)."""
    return graph.induced(graph.vertices.filter(column(keep)))


def filter_edges(graph: Graph, keep: Expr) -> Graph:
    """Edges where the condition holds; all nodes stay."""
    return graph.retain_edges(keep)


def k_hop_neighbors(graph: Graph, start: int, k: int) -> DataFrame:
    """(id) within k hops, start included."""
    return reachable(graph, start, k)


def connected_component(graph: Graph, start: int) -> DataFrame:
    """(id) reachable from start along arcs."""
    return reachable(graph, start)


def component_subgraph(graph: Graph, start: int) -> Graph:
    """Induced by what is reachable; empty for an unknown start."""
    return graph.induced(graph.vertices.join(connected_component(graph, start), "id", "left_semi"))


def boundary_edges(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Edges with exactly one end in ``nodes``."""
    inside = nodes.select("id", F.lit(1).alias("k"))
    e = graph.edges.join(inside.toDF("src", "s"), "src", "left").join(inside.toDF("dst", "d"), "dst", "left")
    return e.filter("(s is null) <> (d is null)").select(*graph.edges.columns)
