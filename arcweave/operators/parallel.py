"""Whole-graph forms of measures: everything is parallel here, so these are names with their own conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.sources import hops
from .centrality import closeness_centrality, pagerank_unweighted
from .components import component_lists, connected_components, connected_components_map
from .metrics import clustering_coefficients, triangles
from .paths import all_pairs_shortest_path_length


def bfs_parallel(graph: Graph, starts: list[int]) -> DataFrame:
    """(src, id, depth) from each start; unknown ones give nothing."""
    return hops(graph, graph.spark.createDataFrame([(s,) for s in starts], "id long"))


def shortest_paths_parallel(graph: Graph, sources: list[int]) -> DataFrame:
    """(src, id, depth): hops; unreachable vertices have no row."""
    return bfs_parallel(graph, sources)


def degrees_parallel(graph: Graph) -> DataFrame:
    """(id, degree): an undirected self-loop counts once."""
    return graph.degrees()


def clustering_coefficients_parallel(graph: Graph) -> DataFrame:
    return clustering_coefficients(graph)


def triangles_parallel(graph: Graph) -> DataFrame:
    return triangles(graph)


def pagerank_parallel(graph: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, nstart: DataFrame | None = None) -> DataFrame:
    return pagerank_unweighted(graph, damping, max_iter, tol, nstart)


def all_pairs_shortest_path_length_parallel(graph: Graph) -> DataFrame:
    return all_pairs_shortest_path_length(graph)


def closeness_centrality_parallel(graph: Graph) -> DataFrame:
    return closeness_centrality(graph)


def connected_components_parallel(graph: Graph) -> DataFrame:
    """(id, component), components numbered from 0."""
    return connected_components_map(graph)


def connected_components_parallel_list(graph: Graph) -> DataFrame:
    """(component, size, members)."""
    return component_lists(connected_components(graph)).orderBy(F.col("component"))
