"""Exceptions, one class per category."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all errors of this library."""


class NodeNotFound(GraphError):
    """A vertex id that the graph doesn't have."""


class EdgeNotFound(GraphError):
    """An edge that the graph doesn't have."""


class NoPath(GraphError):
    """No path between two vertices."""


class NoCycle(GraphError):
    """A cycle was asked for and there is none."""


class HasCycle(GraphError):
    """A graph without cycles was asked for."""


class InvalidGraph(GraphError):
    """The graph doesn't meet what the algorithm asks of it."""


class AlgorithmError(GraphError):
    """The algorithm can't go on."""


class Unfeasible(GraphError):
    """The problem has no solution."""


class Unbounded(GraphError):
    """The problem has no best solution."""


class NotSupported(GraphError):
    """Not implemented for this kind of graph."""


class AmbiguousSolution(GraphError):
    """Several solutions where one was asked for."""


class ExceededMaxIterations(GraphError):
    """The given number of iterations was not enough."""

    def __init__(self, iterations: int, message: str = ""):
        super().__init__(f"{message or 'not done'} after {iterations} iterations")
        self.iterations = iterations


class ConvergenceFailed(ExceededMaxIterations):
    """An iterative method did not settle."""


class GraphIOError(GraphError):
    """Reading or writing failed."""


class SerializationError(GraphError):
    """Stored data can't be read as a graph."""


class InvalidArgument(GraphError, ValueError):
    """An argument out of its range."""


class PointlessConcept(GraphError):
    """The notion has no meaning for the null graph."""
