"""Work per source vertex: a broadcast graph of bounded size, or join-based relaxation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .local import LIMIT, LocalGraph, one_task
from .tables import Steps

#: Most tables that levels stand in before they are written as one.
TABLES = 16


def broadcast_graph(graph):
    """The whole graph as a broadcast ``LocalGraph``; only within LIMIT vertices and edges (checked by the caller)."""
    v = graph.vertices.select("id").toArrow()["id"].to_numpy()
    weight = F.col("weight") if graph.edges.schema["weight"].dataType.typeName() == "long" else F.col("weight").cast("double")
    # A null weight is no number.
    e = graph.edges.select("eid", "src", "dst", weight.alias("weight")).toArrow()
    g = LocalGraph(v, *(e[c].to_numpy() for c in ("eid", "src", "dst", "weight")), graph.directed)
    return graph.spark.sparkContext.broadcast(g)


def per_source(graph, kernel: Callable[[LocalGraph, int], pd.DataFrame | None], schema: str, sources: DataFrame | None = None) -> DataFrame:
    """``kernel(graph, position)`` for every source vertex, sources spread over tasks."""
    shared = broadcast_graph(graph)
    rows = (graph.vertices if sources is None else sources).select("id").distinct()
    names = [f.split()[0] for f in schema.split(", ")]
    tasks = max(1, min(int(graph.spark.sparkContext.defaultParallelism) * 2, 4096))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for frame in frames:
            out, size = [], 0
            for node in frame["id"]:
                at = g.pos(int(node))
                if at < 0:
                    continue
                part = kernel(g, at)
                if part is not None and len(part):
                    out.append(part)
                    size += len(part)
                if size > 500_000:
                    yield pd.concat(out)[names]
                    out, size = [], 0
            if out:
                yield pd.concat(out)[names]

    return rows.repartition(tasks, "id").mapInPandas(run, schema)


def bfs_levels(g: LocalGraph, at: int, view: str = "out", most: int | None = None) -> np.ndarray:
    """Hops from a position; -1 where unreachable."""
    start, to, _ = g.csr(view)
    depth = np.full(g.n, -1, np.int64)
    depth[at] = 0
    frontier, d = np.array([at]), 0
    while len(frontier) and (most is None or d < most):
        d += 1
        count = start[frontier + 1] - start[frontier]
        at_arc = np.repeat(start[frontier] - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())
        nxt = np.unique(to[at_arc])
        frontier = nxt[depth[nxt] < 0]
        depth[frontier] = d
    return depth


def hops(graph, sources: DataFrame | None = None, most: int | None = None, view: str = "out", plan: str = "auto") -> DataFrame:
    """(src, id, depth) of every vertex reached from each source, itself included.

    Unknown sources give nothing.  ``plan``: ``local`` runs one breadth-first search a
    source over a broadcast graph, ``distributed`` joins frontiers with arcs.
    """
    if one_task(graph, plan, LIMIT):

        def kernel(g: LocalGraph, at: int) -> pd.DataFrame:
            depth = bfs_levels(g, at, view, most)
            there = np.flatnonzero(depth >= 0)
            return pd.DataFrame({"src": g.ids[at], "id": g.ids[there], "depth": depth[there]})

        return per_source(graph, kernel, "src long, id long, depth long", sources)
    steps = Steps(graph.spark)
    arcs = steps.write(graph.neighbour_pairs(view, loops=False).toDF("at", "to").repartition("at"))
    rows = graph.vertices.select("id") if sources is None else sources.select("id").distinct().join(graph.vertices.select("id"), "id", "left_semi")
    level = steps.write(rows.select(F.col("id").alias("src"), "id", F.lit(0).cast("long").alias("depth")))
    # Every level is written once; what is reached is their union.
    reached, d = [level], 0
    while most is None or d < most:
        d += 1
        new = level.select("src", F.col("id").alias("at")).join(arcs, "at").select("src", F.col("to").alias("id")).distinct()
        seen = Observation()
        new = new.join(_union(reached).select("src", "id"), ["src", "id"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        level = steps.write(new.observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            break
        reached.append(level)
        if len(reached) > TABLES:
            reached = [steps.write(_union(reached))]
    return _union(reached)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dijkstra(g: LocalGraph, at: int, cutoff: float | None = None, view: str = "out") -> tuple[np.ndarray, np.ndarray]:
    """(distance, predecessor position); the dtype's largest value and -1 where unreachable.

    Of several shortest paths one of fewest edges is taken, of its possible
    predecessors the least.
    """
    start, to, w = g.csr(view)
    if len(w) and (w == w[0]).all() and w[0] > 0:
        return _even_distances(g, at, cutoff, view)
    far = np.iinfo(np.int64).max if np.issubdtype(w.dtype, np.integer) else np.inf
    begin, ends, cost = g.lists(view)
    dist, edges, pred, done = [far] * g.n, [g.n + 1] * g.n, [-1] * g.n, [False] * g.n
    dist[at], edges[at] = 0, 0
    heap = [(0, 0, at)]
    while heap:
        d, k, u = heappop(heap)
        if done[u]:
            continue
        done[u] = True
        k += 1
        for arc in range(begin[u], begin[u + 1]):
            v = ends[arc]
            e = d + cost[arc]
            if e <= dist[v] and (cutoff is None or e <= cutoff):
                if e < dist[v] or k < edges[v]:
                    dist[v], edges[v], pred[v] = e, k, u
                    heappush(heap, (e, k, v))
                elif k == edges[v] and u < pred[v]:
                    pred[v] = u
    return np.array(dist, w.dtype if len(w) else float), np.array(pred, np.int64)


def _even_distances(g: LocalGraph, at: int, cutoff: float | None, view: str) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`dijkstra` where all weights are one positive number: level by level."""
    start, to, w = g.csr(view)
    depth = bfs_levels(g, at, view)
    # Lengths as they add up along a path.
    length = np.concatenate((w[:1] * 0, np.cumsum(np.full(max(1, int(depth.max())), w[0], w.dtype))))
    dist = np.full(g.n, np.iinfo(np.int64).max if np.issubdtype(w.dtype, np.integer) else np.inf, w.dtype)
    there = depth >= 0
    if cutoff is not None:
        there &= length[np.maximum(depth, 0)] <= cutoff
    dist[there] = length[depth[there]]
    origin = np.repeat(np.arange(g.n), np.diff(start))
    down = there[origin] & there[to] & (depth[to] == depth[origin] + 1)
    pred = np.full(g.n, g.n, np.int64)
    np.minimum.at(pred, to[down], origin[down])
    pred[pred == g.n] = -1
    return dist, pred


def distances(graph, sources: DataFrame | None = None, cutoff: float | None = None, plan: str = "auto", view: str = "out", rounds: int | None = None) -> DataFrame:
    """(src, id, dist, pred) of what each source reaches; weights must not be negative for the local plan.

    Null weights are impassable.  Whole-number weights give whole-number distances,
    exact to 64 bits; any others are doubles.  Of several shortest paths one of fewest
    edges counts, of its possible predecessors the least id, in either plan.  The
    distributed plan relaxes the arcs of what improved in the round before; with
    ``rounds`` it returns after that many even if it still improves, and the result has
    ``improving`` as its attribute.
    """
    kind = "long" if graph.edges.schema["weight"].dataType.typeName() in ("long", "integer", "short", "byte") else "double"
    graph = graph.map_edge_weights(F.col("weight").cast(kind))
    if one_task(graph, plan, LIMIT):

        def kernel(g: LocalGraph, at: int) -> pd.DataFrame:
            dist, pred = dijkstra(g, at, cutoff, view)
            there = np.flatnonzero((pred >= 0) | (np.arange(g.n) == at))
            p = pd.array(g.ids[np.maximum(pred[there], 0)], dtype="Int64")
            p[pred[there] < 0] = pd.NA
            return pd.DataFrame({"src": g.ids[at], "id": g.ids[there], "dist": dist[there], "pred": p})

        return per_source(graph, kernel, f"src long, id long, dist {kind}, pred long", sources)
    steps = Steps(graph.spark)
    arcs = graph.arcs(view).filter("weight is not null").groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.min("weight").alias("w"))
    arcs = steps.write(arcs.repartition("at"))
    rows = graph.vertices.select("id") if sources is None else sources.select("id").distinct().join(graph.vertices.select("id"), "id", "left_semi")
    zero = F.lit(0).cast(kind)
    state = steps.write(rows.select(F.col("id").alias("src"), "id", zero.alias("dist"), F.lit(0).alias("edges"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("new")))
    k = 0
    while True:
        step = state.filter("new").select("src", F.col("id").alias("at"), "dist", "edges").join(arcs, "at")
        step = step.select("src", F.col("to").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("edges") + 1).alias("edges"), F.col("at").alias("pred"))
        if cutoff is not None:
            step = step.filter(F.col("dist") <= cutoff)
        both = state.select("src", "id", "dist", "edges", "pred", F.lit(False).alias("fresh")).unionByName(step.withColumn("fresh", F.lit(True)))
        best = both.groupBy("src", "id").agg(F.min(F.struct("dist", "edges", "pred")).alias("b"), F.min(F.when(~F.col("fresh"), F.struct("dist", "edges"))).alias("old"))
        # What has only another predecessor moves nothing on.
        improved = F.col("old").isNull() | (F.struct("b.dist", "b.edges") < F.col("old"))
        seen = Observation()
        best = best.select("src", "id", "b.dist", "b.edges", "b.pred", improved.alias("new")).observe(seen, F.count(F.when(F.col("new"), 1)).alias("n"))
        state = steps.write(best, replaces=state)
        k += 1
        improving = seen.get["n"] > 0
        if not improving or rounds is not None and k >= rounds:
            out = state.select("src", "id", "dist", "pred")
            out.improving = improving
            return out


#: Whole weights up to this are searched a level at a time, for many targets at once as bits; most bytes of the arcs' bits.
WHOLE, BITS = 64, 64 << 20


def distance_sums(graph, plan: str = "auto") -> DataFrame:
    """(id, r, s, h, z): of the others that a vertex reaches along out-arcs, how many are at a positive distance, the sum of those distances and of their inverses, and how many are at distance 0.

    Vertices that reach nothing may be missing.  Over a broadcast graph only these sums
    leave a task; beyond its size :func:`distances` is aggregated.
    """
    if not one_task(graph, plan, LIMIT):
        d = distances(graph, plan=plan).filter("src <> id").select("src", F.col("dist").cast("double").alias("d"))
        far = F.when(F.col("d") > 0, F.col("d"))
        return d.groupBy(F.col("src").alias("id")).agg(F.count(far).alias("r"), F.sum(far).alias("s"), F.sum(1.0 / far).alias("h"), F.count(F.when(F.col("d") == 0, 1)).alias("z"))
    kind = "long" if graph.edges.schema["weight"].dataType.typeName() in ("long", "integer", "short", "byte") else "double"
    shared = broadcast_graph(graph.map_edge_weights(F.col("weight").cast(kind)))
    w, n = shared.value.weight, shared.value.n
    w = w[w == w]
    steps = bool(((w >= 1) & (w <= WHOLE) & (w == np.floor(w))).all())
    words = int(min(16, max(1, BITS // (16 * max(1, len(w))))))
    size = 64 * words if steps else 64
    tasks = max(1, min(int(graph.spark.sparkContext.defaultParallelism) * 2, 4096, -(-n // size)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        sums = np.zeros((4, g.n))
        arcs = _by_weight(g) if steps else None
        for frame in frames:
            for i in frame["id"]:
                part = np.arange(i * size, min(g.n, (i + 1) * size))
                if steps:
                    _sums_to(g.n, arcs, part, sums)
                else:
                    for at in part.tolist():
                        dist, pred = dijkstra(g, at)
                        d = dist[(pred >= 0) & (np.arange(g.n) != at)]
                        far = d[d > 0].astype(float)
                        sums[:, at] = len(far), far.sum(), (1 / far).sum(), len(d) - len(far)
        there = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"id": g.ids[there], "r": sums[0, there].astype(np.int64), "s": sums[1, there], "h": sums[2, there], "z": sums[3, there].astype(np.int64)})

    parts = graph.spark.range(-(-n // size), numPartitions=tasks).mapInPandas(run, "id long, r long, s double, h double, z long")
    return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in "rshz"])


def _by_weight(g: LocalGraph) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(weight, from, to) of the arcs of each weight, by ascending origin."""
    s, d, w = g.arcs("out")
    use = (w == w) & (s != d)
    s, d, w = s[use], d[use], w[use]
    out = []
    for x in np.unique(w):
        a, b = s[w == x], d[w == x]
        order = np.argsort(a, kind="stable")
        out.append((int(x), a[order], b[order]))
    return out


def _sums_to(n: int, arcs: list[tuple[int, np.ndarray, np.ndarray]], targets: np.ndarray, sums: np.ndarray) -> None:
    """Adds to ``sums`` (r, s, h, z) of every vertex its distances to the targets: a bit a target, a level a distance, from the targets backwards."""
    if not len(targets):
        return
    seen = np.zeros((n, -(-len(targets) // 64)), np.uint64)
    at = np.arange(len(targets))
    seen[targets, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    levels = {0: (seen.copy(), seen.any(axis=1))}
    longest, d = max((w for w, _, _ in arcs), default=0), 0
    while levels:
        d += 1
        new = np.zeros_like(seen)
        for w, a, b in arcs:
            if d - w in levels:
                bits, active = levels[d - w]
                use = active[b]
                v, u = a[use], b[use]
                if len(v):
                    first = np.flatnonzero(np.diff(v, prepend=-1))
                    new[v[first]] |= np.bitwise_or.reduceat(bits[u], first, axis=0)
        new &= ~seen
        rows = new.any(axis=1)
        if rows.any():
            seen |= new
            levels[d] = new, rows
            count = np.bitwise_count(new).sum(axis=1)
            sums[0] += count
            sums[1] += count * float(d)
            sums[2] += count / d
        levels.pop(d - longest, None)
