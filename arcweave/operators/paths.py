"""Shortest paths. Missing rows mean unreachable in the long form; ``complete`` adds them as null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NoPath
from ..graph import Expr, Graph, column
from ..plans.local import LIMIT, LocalGraph, fits, one_task, run_local
from ..plans.sources import distances, hops
from ..plans.tables import Steps


#: Most vertices and edges that :func:`floyd_warshall` holds as a dense table.
DENSE = 4_000


def complete(graph: Graph, rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A row for every (source, vertex), unreachable ones null."""
    src = (graph.vertices if sources is None else sources).select(F.col("id").alias("src")).distinct()
    return src.crossJoin(graph.vertices.select("id")).join(rows, ["src", "id"], "left")


def dijkstra(graph: Graph, source: int, cutoff: float | None = None, cost: Expr | None = None, plan: str = "auto") -> DataFrame:
    """(id, dist, pred) for every vertex; null where unreachable or beyond ``cutoff`` (inclusive).

    ``cost`` is a column over the edge columns, by default the weight; a null cost is
    impassable.  Whole-number costs give whole-number distances, any others doubles.  A negative or NaN cost raises InvalidArgument if the edge is reached.
    """
    graph.require_nodes(source)
    g = graph if cost is None else _costed(graph, cost)
    seen = distances(Graph(g.vertices, g.edges.filter("weight is not null"), g.directed), _one(g, source), cutoff, plan) if _clean(g) else _checked(g, source, cutoff, plan)
    return graph.vertices.select("id").join(seen.select("id", "dist", "pred"), "id", "left")


def _costed(graph: Graph, cost: Expr) -> Graph:
    edges = graph.edges.withColumn("weight", column(cost))
    whole = edges.schema["weight"].dataType.typeName() in ("long", "integer", "short", "byte")
    return graph.with_parts(edges=edges.withColumn("weight", F.col("weight").cast("long" if whole else "double")))


def _one(graph: Graph, node: int) -> DataFrame:
    return graph.spark.createDataFrame([(node,)], "id long")


def _bad(e: DataFrame) -> DataFrame:
    # -0.0 counts as negative: its text has the sign.
    return e.filter("weight is not null and (isnan(weight) or weight < 0 or cast(weight as string) = '-0.0')")


def _clean(g: Graph) -> bool:
    return _bad(g.edges).isEmpty()


def _checked(g: Graph, source: int, cutoff: float | None, plan: str) -> DataFrame:
    """Distances over good edges; raises if a bad one starts at a vertex that is reached."""
    good = Graph(g.vertices, g.edges.filter("weight is not null").join(_bad(g.edges).select("eid"), "eid", "left_anti").select(*g.edges.columns), g.directed)
    seen = distances(good, _one(g, source), cutoff, plan)
    bad = Graph(g.vertices, _bad(g.edges), g.directed).arcs("out").select(F.col("src").alias("id"))
    if not bad.join(seen.select("id"), "id", "left_semi").isEmpty():
        raise InvalidArgument("a negative or NaN cost was reached")
    return seen


def bellman_ford(graph: Graph, source: int, plan: str = "auto") -> DataFrame | None:
    """(id, dist), null where unreachable; None if a negative cycle is reachable. Weights may be negative."""
    local = one_task(graph, plan, LIMIT)
    rows = _bf_local(graph, source) if local else distances(graph, _one(graph, source), plan="distributed", rounds=max(1, graph.node_count()))
    if rows is None or getattr(rows, "improving", False):
        return None
    return graph.vertices.select("id").join(rows.select("id", "dist"), "id", "left")


def _relax(g: LocalGraph, at: int | None) -> np.ndarray | None:
    s, d, w = g.arcs("out")
    use = ~np.isnan(w)
    s, d, w = s[use], d[use], w[use]
    dist = np.full(g.n, np.inf) if at is not None else np.zeros(g.n)
    if at is not None:
        dist[at] = 0.0
    pred = np.arange(g.n)
    for k in range(1, g.n + 1):
        new = dist.copy()
        through = dist[s] + w
        np.minimum.at(new, d, through)
        better = new < dist
        if not better.any():
            return dist
        tight = better[d] & (through == new[d])
        pred[d[tight]] = s[tight]
        dist = new
        # Predecessors in a circle are a negative cycle: looked for after 8, 16, 32, ... rounds.
        if k >= 8 and k & (k - 1) == 0 and _has_circle(pred):
            return None
    return None


def _has_circle(pred: np.ndarray) -> bool:
    """Whether following predecessors (a root is its own) ever goes in a circle."""
    end = pred
    for _ in range(max(1, len(pred)).bit_length() + 1):
        end = end[end]
    return bool((pred[end] != end).any())


def _bf_local(graph: Graph, source: int) -> DataFrame | None:
    def kernel(g: LocalGraph) -> pd.DataFrame:
        at = g.pos(source)
        if at < 0:
            return pd.DataFrame()
        dist = _relax(g, at)
        if dist is None:
            return pd.DataFrame({"id": [source], "dist": [math.nan]})
        there = np.flatnonzero(np.isfinite(dist))
        return pd.DataFrame({"id": g.ids[there], "dist": dist[there]})

    steps = Steps(graph.spark)
    rows = steps.write(run_local(graph, kernel, "id long, dist double"))
    return rows if rows.filter("dist is null or isnan(dist)").isEmpty() else None


def _path(rows: dict[int, tuple[float, int | None]], target: int) -> list[int]:
    path = [target]
    while rows[path[-1]][1] is not None:
        path.append(rows[path[-1]][1])
    return path[::-1]


def shortest_path(graph: Graph, source: int, target: int, cost: Expr | None = None) -> tuple[float, list[int]] | None:
    """(cost, path) or None; predecessors are followed backwards.

    Within what one task takes the predecessors come to the driver at once; beyond it
    they are looked up one a step.
    """
    graph.require_nodes(source, target)
    steps = Steps(graph.spark)
    rows = steps.write(dijkstra(graph, source, cost=cost))
    row = rows.filter(F.col("id") == target).first()
    if row is None or row["dist"] is None:
        return None
    if graph.size_upto(LIMIT) <= LIMIT:
        reached = rows.filter("pred is not null").select("id", "pred").toArrow()
        before = dict(zip(reached["id"].to_pylist(), reached["pred"].to_pylist()))
        path = [target]
        while path[-1] != source:
            path.append(before[path[-1]])
        return row["dist"], path[::-1]
    path, at = [target], row
    while at["id"] != source:
        at = rows.filter(F.col("id") == at["pred"]).first()
        path.append(at["id"])
    return row["dist"], path[::-1]


def a_star(graph: Graph, source: int, target: int, heuristic: Expr | None = None, cost: Expr | None = None) -> tuple[float, list[int]] | None:
    """(cost, path) or None if unreachable.

    ``heuristic`` is a column over the vertex columns, a lower bound of the way to the
    target.  The search is one task's; without a bound it is :func:`shortest_path`.
    """
    if heuristic is None or not fits(graph, LIMIT):
        return shortest_path(graph, source, target, cost)
    graph.require_nodes(source, target)
    g = graph if cost is None else graph.with_parts(edges=graph.edges.withColumn("weight", column(cost).cast("double")))
    if not _clean(g):
        raise InvalidArgument("weights must not be negative")
    bound = {r["id"]: r["h"] for r in graph.vertices.select("id", column(heuristic).cast("double").alias("h")).toLocalIterator()}

    def kernel(lg: LocalGraph) -> pd.DataFrame:
        import heapq

        s, t = lg.pos(source), lg.pos(target)
        start, to, w = lg.csr("out")
        best, pred = {s: 0.0}, {s: -1}
        heap, done = [(bound.get(source) or 0.0, s)], set()
        while heap:
            _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u == t:
                break
            for k in range(start[u], start[u + 1]):
                v, d = int(to[k]), best[u] + w[k]
                if d == d and d < best.get(v, math.inf):
                    best[v], pred[v] = d, u
                    done.discard(v)
                    heapq.heappush(heap, (d + (bound.get(int(lg.ids[v])) or 0.0), v))
        if t not in best:
            return pd.DataFrame()
        path = [t]
        while pred[path[-1]] >= 0:
            path.append(pred[path[-1]])
        return pd.DataFrame({"pos": range(len(path)), "id": lg.ids[path[::-1]], "cost": best[t]})

    rows = run_local(g, kernel, "pos long, id long, cost double").orderBy("pos").collect()
    return (rows[0]["cost"], [r["id"] for r in rows]) if rows else None


def ida_star(graph: Graph, source: int, target: int, heuristic: Expr | None = None) -> tuple[float, list[int]]:
    """As :func:`a_star`, raising NoPath; the answer of iterative deepening is the same."""
    found = a_star(graph, source, target, heuristic)
    if found is None:
        raise NoPath(f"{source} to {target}")
    return found


def floyd_warshall(graph: Graph, plan: str = "auto") -> DataFrame:
    """(src, id, dist) of all reachable pairs, diagonal 0; negative cycles are not detected.

    Distributed: min-plus squaring, ceil(log2 n) joins.
    """
    if one_task(graph, plan, DENSE):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            d = np.full((g.n, g.n), np.inf)
            s, t, w = g.arcs("out")
            np.minimum.at(d, (s, t), w)
            for k in range(g.n):
                np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
            np.fill_diagonal(d, 0.0)
            a, b = np.nonzero(np.isfinite(d))
            return pd.DataFrame({"src": g.ids[a], "id": g.ids[b], "dist": d[a, b]})

        return run_local(graph, kernel, "src long, id long, dist double")
    steps, n = Steps(graph.spark), graph.node_count()
    zero = graph.vertices.select(F.col("id").alias("src"), "id", F.lit(0.0).alias("dist"))
    table = graph.arcs("out").select("src", F.col("dst").alias("id"), F.col("weight").alias("dist")).unionByName(zero).groupBy("src", "id").agg(F.min("dist").alias("dist"))
    table = steps.write(table)
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        on = table.select(F.col("src").alias("id"), F.col("id").alias("far"), F.col("dist").alias("more"))
        two = table.join(on, "id").select("src", F.col("far").alias("id"), (F.col("dist") + F.col("more")).alias("dist"))
        table = steps.write(table.unionByName(two).groupBy("src", "id").agg(F.min("dist").alias("dist")), replaces=table)
    return table.withColumn("dist", F.when(F.col("src") == F.col("id"), 0.0).otherwise(F.col("dist")))


def johnson(graph: Graph, plan: str = "auto") -> DataFrame | None:
    """(src, id, dist) of all reachable pairs, weights may be negative; None on a negative cycle."""
    if one_task(graph, plan, LIMIT):

        def potentials(g: LocalGraph) -> pd.DataFrame:
            h = _relax(g, None)
            return pd.DataFrame({"id": [], "h": []}) if h is None else pd.DataFrame({"id": g.ids, "h": h})

        steps = Steps(graph.spark)
        h = steps.write(run_local(graph, potentials, "id long, h double"))
        if h.isEmpty() and not graph.is_empty():
            return None
        hs, hd = h.toDF("src", "hs"), h.toDF("dst", "hd")
        # Reweighted arcs are not negative, whichever way they are walked.
        arcs = graph.arcs("out").join(hs, "src").join(hd, "dst").withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") + F.col("hs") - F.col("hd")))
        g = Graph(graph.vertices, arcs.select(F.monotonically_increasing_id().alias("eid"), "src", "dst", "weight"), True)
        rows = distances(g, plan="local")
        return rows.join(hs, "src").join(h.toDF("id", "hd"), "id").select("src", "id", (F.col("dist") - F.col("hs") + F.col("hd")).alias("dist"))
    rows = distances(graph, plan="distributed", rounds=graph.node_count())
    return None if rows.improving else rows.select("src", "id", "dist")


def all_pairs_shortest_path_length(graph: Graph, plan: str = "auto") -> DataFrame:
    """(src, id, depth): hops of all reachable pairs, diagonal 0."""
    return hops(graph, plan=plan)


def multi_source_hops(graph: Graph, sources: DataFrame, max_depth: int | None = None, plan: str = "auto") -> DataFrame:
    """(src, id, depth) from the given sources (id)."""
    return hops(graph, sources, max_depth, plan=plan)
