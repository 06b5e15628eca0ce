"""Predicates, and preconditions that raise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import HasCycle, InvalidArgument, InvalidGraph
from ..graph import Graph
from .components import count_components, is_bipartite, is_connected, is_dag  # noqa: F401


def is_empty(graph: Graph) -> bool:
    return graph.is_empty()


def has_negative_weights(graph: Graph) -> bool:
    return not graph.edges.filter("weight < 0").isEmpty()


def has_self_loops(graph: Graph) -> bool:
    return not graph.edges.filter(F.col("src") == F.col("dst")).isEmpty()


def _of(algorithm: str) -> str:
    return f"{algorithm}: " if algorithm else ""


def require_non_empty(graph: Graph, algorithm: str = "") -> None:
    if graph.is_empty():
        raise InvalidGraph(f"{_of(algorithm)}the graph has no vertices")


def require_connected(graph: Graph, algorithm: str = "") -> None:
    if not is_connected(graph):
        raise InvalidGraph(f"{_of(algorithm)}the graph is not connected")


def require_non_negative_weights(graph: Graph, algorithm: str = "") -> None:
    if has_negative_weights(graph):
        raise InvalidArgument(f"{_of(algorithm)}weights must not be negative")


def require_no_self_loops(graph: Graph, algorithm: str = "") -> None:
    if has_self_loops(graph):
        raise InvalidGraph(f"{_of(algorithm)}there are self-loops")


def require_dag(graph: Graph, algorithm: str = "") -> None:
    if not graph.directed:
        raise InvalidGraph(f"{_of(algorithm)}the graph is not directed")
    if not is_dag(graph):
        raise HasCycle(f"{_of(algorithm)}the graph has a cycle")


def validate_for_algorithm(graph: Graph, algorithm: str = "") -> None:
    require_non_empty(graph, algorithm)
    require_connected(graph, algorithm)
    require_non_negative_weights(graph, algorithm)


def validate_node_exists(graph: Graph, node: int) -> None:
    graph.require_nodes(node)


validate_non_empty, validate_connected = require_non_empty, require_connected
validate_non_negative_weights, validate_is_dag = require_non_negative_weights, require_dag
