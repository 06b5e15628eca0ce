"""Breadth-first, depth-first, depth-limited and two-sided search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import NoPath
from ..graph import Graph
from ..plans.local import LIMIT, LocalGraph, one_task, run_local
from ..plans.sources import bfs_levels, hops
from ..plans.tables import Steps


def _as_source(graph: Graph, *nodes: int) -> DataFrame:
    return graph.spark.createDataFrame([(n,) for n in nodes], "id long")


def bfs(graph: Graph, start: int, max_depth: int | None = None, plan: str = "auto") -> DataFrame:
    """(id, depth) of what is reachable, in canonical order (depth, id); empty for an unknown start."""
    return hops(graph, _as_source(graph, start), max_depth, plan=plan).select("id", "depth").orderBy("depth", "id")


def dfs(graph: Graph, start: int) -> DataFrame:
    """(pos, id) in depth-first preorder, neighbours by ascending id; empty for an unknown start."""

    def kernel(g: LocalGraph) -> pd.DataFrame:
        at = g.pos(start)
        begin, to, _ = g.csr("out")
        seen, out, stack = np.zeros(g.n, bool), [], [at] if at >= 0 else []
        while stack:
            u = stack.pop()
            if seen[u]:
                continue
            seen[u] = True
            out.append(u)
            stack.extend(v for v in to[begin[u] : begin[u + 1]][::-1].tolist() if not seen[v])
        return pd.DataFrame({"pos": np.arange(len(out)), "id": g.ids[out] if out else np.zeros(0, np.int64)})

    return run_local(graph, kernel, "pos long, id long")


class _Side:
    """Levels of a breadth-first search, one table a level; ``view`` is the direction it goes in."""

    def __init__(self, graph: Graph, start: int, view: str, steps: Steps):
        self.steps, self.size = steps, 1
        self.arcs = steps.write(graph.neighbour_pairs(view, loops=False).toDF("at", "to"))
        self.levels = [_as_source(graph, start)]

    def grow(self) -> None:
        """Adds the next level."""
        seen = Observation()
        new = self.levels[-1].toDF("at").join(self.arcs, "at").select(F.col("to").alias("id")).distinct()
        for level in self.levels:
            new = new.join(level, "id", "left_anti")
        self.levels.append(self.steps.write(new.observe(seen, F.count("*").alias("n"))))
        self.size = seen.get["n"]

    def back(self, node: int, depth: int) -> list[int]:
        """From a vertex of level ``depth`` to the start, each time to the least vertex of the level before."""
        path = [node]
        for level in reversed(self.levels[:depth]):
            before = self.arcs.filter(F.col("to") == path[-1]).join(level.toDF("at"), "at", "left_semi")
            path.append(before.agg(F.min("at")).first()[0])
        return path


def hop_path(graph: Graph, start: int, target: int, max_depth: int | None = None, plan: str = "auto") -> list[int] | None:
    """A path of fewest hops, at most ``max_depth``; of several parents the least id.  None if there is none."""
    if not one_task(graph, plan, LIMIT):
        if not (graph.contains_node(start) and graph.contains_node(target)):
            return None
        side = _Side(graph, start, "out", Steps(graph.spark))
        while side.size and side.levels[-1].filter(F.col("id") == target).isEmpty():
            if max_depth is not None and len(side.levels) > max_depth:
                return None
            side.grow()
        return side.back(target, len(side.levels) - 1)[::-1] if side.size else None

    def kernel(g: LocalGraph) -> pd.DataFrame:
        s, t = g.pos(start), g.pos(target)
        if s < 0 or t < 0:
            return pd.DataFrame()
        depth = bfs_levels(g, s, "out", max_depth)
        if depth[t] < 0:
            return pd.DataFrame()
        path = _back(g, "in", depth, t)
        return pd.DataFrame({"pos": np.arange(len(path)), "id": g.ids[path[::-1]]})

    rows = run_local(graph, kernel, "pos long, id long").orderBy("pos").collect()
    return [r["id"] for r in rows] or None


def _back(g: LocalGraph, view: str, depth: np.ndarray, at: int) -> list[int]:
    """Positions from ``at`` to depth 0, each time to the least one a level before."""
    begin, to, _ = g.csr(view)
    path = [at]
    while depth[path[-1]]:
        u = path[-1]
        before = to[begin[u] : begin[u + 1]]
        path.append(int(before[depth[before] == depth[u] - 1].min()))
    return path


def iddfs(graph: Graph, start: int, target: int, max_depth: int, plan: str = "auto") -> list[int] | None:
    """A path of at most ``max_depth`` edges, or None."""
    return hop_path(graph, start, target, max_depth, plan)


def bidirectional_search(graph: Graph, start: int, target: int, plan: str = "auto") -> list[int] | None:
    """A path of fewest hops, or None; [start] if both are one known node.

    Two searches, along out-arcs from the start and against them from the target; the
    one with the smaller frontier (of equal ones the first) goes on, until they meet.
    Of the vertices where they meet the least is taken, and least parents either way.
    """
    if not one_task(graph, plan, LIMIT):
        if not (graph.contains_node(start) and graph.contains_node(target)):
            return None
        if start == target:
            return [start]
        steps = Steps(graph.spark)
        ahead, behind = _Side(graph, start, "out", steps), _Side(graph, target, "in", steps)
        while ahead.size and behind.size:
            (ahead if ahead.size <= behind.size else behind).grow()
            met = ahead.levels[-1].join(behind.levels[-1], "id", "left_semi").agg(F.min("id")).first()[0]
            if met is not None:
                return ahead.back(met, len(ahead.levels) - 1)[::-1] + behind.back(met, len(behind.levels) - 1)[1:]
        return None

    def kernel(g: LocalGraph) -> pd.DataFrame:
        s, t = g.pos(start), g.pos(target)
        if s < 0 or t < 0:
            return pd.DataFrame()
        depths, frontiers = [np.full(g.n, -1, np.int64) for _ in range(2)], [np.array([s]), np.array([t])]
        depths[0][s] = depths[1][t] = 0
        met = np.array([s]) if s == t else np.zeros(0, np.int64)
        while not len(met) and len(frontiers[0]) and len(frontiers[1]):
            side = 0 if len(frontiers[0]) <= len(frontiers[1]) else 1
            begin, to, _ = g.csr("in" if side else "out")
            near = np.unique(np.concatenate([to[begin[u] : begin[u + 1]] for u in frontiers[side]]))
            new = near[depths[side][near] < 0]
            depths[side][new] = depths[side][frontiers[side][0]] + 1
            frontiers[side] = new
            met = new[depths[1 - side][new] >= 0]
        if not len(met):
            return pd.DataFrame()
        path = _back(g, "in", depths[0], int(met.min()))[::-1] + _back(g, "out", depths[1], int(met.min()))[1:]
        return pd.DataFrame({"pos": np.arange(len(path)), "id": g.ids[path]})

    rows = run_local(graph, kernel, "pos long, id long").orderBy("pos").collect()
    return [r["id"] for r in rows] or None


bidis = bidirectional_search


def _or_raise(graph: Graph, path: list[int] | None, start: int, target: int) -> list[int]:
    graph.require_nodes(start, target)
    if path is None:
        raise NoPath(f"{start} to {target}")
    return path


def try_iddfs(graph: Graph, start: int, target: int, max_depth: int) -> list[int]:
    """As :func:`iddfs`; raises NodeNotFound or NoPath."""
    return _or_raise(graph, iddfs(graph, start, target, max_depth), start, target)


def try_bidirectional_search(graph: Graph, start: int, target: int) -> list[int]:
    """As :func:`bidirectional_search`; raises NodeNotFound or NoPath."""
    return _or_raise(graph, bidirectional_search(graph, start, target), start, target)


def reachable(graph: Graph, start: int, k: int | None = None) -> DataFrame:
    """(id) within k hops, start included; empty for an unknown start."""
    return hops(graph, _as_source(graph, start), k).select("id")


def path_frame(graph: Graph, path: list[int] | None) -> DataFrame:
    """(pos, id) of a path."""
    return graph.spark.createDataFrame(list(enumerate(path or [])), "pos long, id long")


def levels(graph: Graph, start: int) -> DataFrame:
    """(depth, n): how many vertices each level has."""
    return bfs(graph, start).groupBy("depth").agg(F.count("*").alias("n"))
