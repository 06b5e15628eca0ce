"""Heuristics for hard problems, with fixed rules for ties."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AlgorithmError, InvalidGraph
from ..graph import Graph
from ..plans.compiled import PACKED, pack, register
from ..plans.local import LocalGraph, one_task, run_local
from ..plans.tables import Steps
from .components import SMALL, union_find
from .metrics import triangles

IDS = "id long"


def _frame(g: LocalGraph, members) -> pd.DataFrame:
    return pd.DataFrame({"id": g.ids[sorted(members)]} if len(members) else {"id": np.zeros(0, np.int64)})


def _sets(g: LocalGraph) -> list[set[int]]:
    near = g.neighbour_sets("sym")
    for i, x in enumerate(near):
        x.discard(i)
    return near


def _greedy_clique(near: list[set[int]]) -> set[int]:
    """From every seed, neighbours by falling degree (then id) are added while adjacent to all; the first largest wins."""
    best: set[int] = set()
    for seed in range(len(near)):
        if len(near[seed]) + 1 <= len(best):
            continue
        clique = {seed}
        for v in sorted(near[seed], key=lambda x: (-len(near[x]), x)):
            if clique <= near[v]:
                clique.add(v)
        if len(clique) > len(best):
            best = clique
    return best


def max_clique(graph: Graph) -> DataFrame:
    """(id) of a large clique."""
    return run_local(graph, lambda g: _frame(g, _greedy_clique(_sets(g))), IDS)


def large_clique_size(graph: Graph) -> int:
    return max_clique(graph).count()


def clique_removal(graph: Graph) -> DataFrame:
    """(clique, id): a partition into greedy cliques, each taken from what the ones before left.

    A seed's greedy clique is grown again only when a neighbour of the seed has gone.
    """

    def kernel(g: LocalGraph) -> pd.DataFrame:
        near, rows, k = _sets(g), [], 0
        left = [True] * g.n
        rank = np.empty(g.n, np.int64)
        rank[np.lexsort((np.arange(g.n), [-len(x) for x in near]))] = np.arange(g.n)
        rank = rank.tolist()

        def grown(seed: int) -> set[int]:
            clique = {seed}
            for v in sorted(near[seed], key=rank.__getitem__):
                if clique <= near[v]:
                    clique.add(v)
            return clique

        size = [len(grown(v)) for v in range(g.n)]
        heap = [(-c, v) for v, c in enumerate(size)]
        heapq.heapify(heap)
        while heap:
            c, v = heapq.heappop(heap)
            if not left[v] or -c != size[v]:
                continue
            clique = grown(v)
            rows += [(k, int(g.ids[u])) for u in sorted(clique)]
            k += 1
            touched = set().union(*(near[u] for u in clique)) - clique
            for u in clique:
                left[u] = False
            for u in touched:
                near[u] -= clique
            for u in touched:
                now = len(grown(u))
                if now != size[u]:
                    size[u] = now
                    heapq.heappush(heap, (-now, u))
        return pd.DataFrame(rows, columns=["clique", "id"])

    return run_local(graph, kernel, "clique long, id long")


def maximum_independent_set(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id): vertices by rising (degree, id) are taken unless a neighbour was.

    Distributed: rounds in which every undecided vertex that precedes all its undecided
    neighbours is taken; the set is the same.
    """
    if one_task(graph, plan, SMALL):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            near = _sets(g)
            degree = np.bincount(g.arcs("out")[0], minlength=g.n)
            taken, blocked = [], set()
            for v in np.lexsort((np.arange(g.n), degree)).tolist():
                if v not in blocked:
                    taken.append(v)
                    blocked |= near[v]
            return _frame(g, taken)

        return run_local(graph, kernel, IDS)
    steps = Steps(graph.spark)
    pairs = graph.neighbour_pairs("sym", loops=False)
    d = graph.out_degrees().toDF("id", "d")
    left = steps.write(d)
    pairs = steps.write(pairs.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst"))
    taken = steps.write(d.select("id").limit(0))
    while not left.isEmpty():
        beaten = pairs.filter(F.struct("dd", "dst") < F.struct("ds", "src")).select(F.col("src").alias("id")).distinct()
        now = steps.write(left.join(beaten, "id", "left_anti").select("id"))
        gone = now.unionByName(pairs.join(now.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()
        left = steps.write(left.join(gone, "id", "left_anti"))
        pairs = steps.write(pairs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
        taken = steps.write(taken.unionByName(now))
    return taken


def min_maximal_matching(graph: Graph, plan: str = "auto") -> DataFrame:
    """(eid, u, v): edges by id are taken unless they touch one taken before; a self-loop can be."""
    if one_task(graph, plan, SMALL):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            used, keep = np.zeros(g.n, bool), []
            for k, (a, b) in enumerate(zip(g.src.tolist(), g.dst.tolist())):
                if not used[a] and not used[b]:
                    used[a] = used[b] = True
                    keep.append(k)
            return pd.DataFrame({"eid": g.eid[keep], "u": g.ids[g.src[keep]], "v": g.ids[g.dst[keep]]})

        return run_local(graph, kernel, "eid long, u long, v long")
    steps = Steps(graph.spark)
    left = steps.write(graph.edges.select("eid", F.col("src").alias("u"), F.col("dst").alias("v")))
    taken = steps.write(left.limit(0))
    while not left.isEmpty():
        ends = left.select("eid", F.explode(F.array_distinct(F.array("u", "v"))).alias("id"))
        first = ends.groupBy("id").agg(F.min("eid").alias("least"))
        now = steps.write(left.join(first.toDF("u", "lu"), "u").join(first.toDF("v", "lv"), "v").filter("eid = lu and eid = lv").select("eid", "u", "v"))
        used = now.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        left = steps.write(left.join(used.toDF("u"), "u", "left_anti").join(used.toDF("v"), "v", "left_anti"))
        taken = steps.write(taken.unionByName(now))
    return taken


def average_clustering(graph: Graph) -> DataFrame:
    """One row: mean clustering over vertices with at least two neighbours; 0 if there are none."""
    k = graph.neighbour_pairs("sym", loops=False).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    c = triangles(graph).join(k, "id").filter("k >= 2").select((2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).alias("c"))
    return c.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("average_clustering"))


def local_node_connectivity(graph: Graph, source: int, target: int) -> int:
    """Lower bound of the number of paths without common inner vertices: shortest ones (least parents) are blocked in turn; a direct edge counts and ends the search."""

    def kernel(g: LocalGraph) -> pd.DataFrame:
        s, t = g.pos(source), g.pos(target)
        if s < 0 or t < 0 or s == t:
            return pd.DataFrame({"n": [0]})
        near, blocked, n = [sorted(set(x)) for x in g.neighbours("out")], set(), 0
        while True:
            pred, order = {s: s}, [s]
            for u in order:
                if u == t:
                    break
                for v in near[u]:
                    if v not in pred and v not in blocked:
                        pred[v] = u
                        order.append(v)
            if t not in pred:
                return pd.DataFrame({"n": [n]})
            n += 1
            at = pred[t]
            if at == s:
                return pd.DataFrame({"n": [n]})
            while at != s:
                blocked.add(at)
                at = pred[at]

    return run_local(graph, kernel, "n long").first()["n"]


def ramsey_r2(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(clique, independent set)."""
    return max_clique(graph), maximum_independent_set(graph)


def densest_subgraph(graph: Graph, plan: str = "auto", epsilon: float | None = None) -> DataFrame:
    """(id) of a dense part: vertices are peeled off in rounds, the densest stage (the earliest of such) stays.

    A round takes all vertices of least degree and all of a degree below the greatest
    density so far, which no densest part holds: within a factor 2 of the best.  With
    ``epsilon`` it takes all of degree up to 2 (1 + epsilon) times the density: within
    2 (1 + epsilon), in far fewer rounds where parts are sparse and long.  Both plans
    follow the same rule; ``auto`` ends a large graph locally once the rest is small.
    """

    def kernel(g: LocalGraph, best: float = 0.0) -> pd.DataFrame:
        near = _sets(g)
        degree = [len(x) for x in near]
        m, heap, alive = sum(degree) // 2, [(d, v) for v, d in enumerate(degree) if d], [d > 0 for d in degree]
        heapq.heapify(heap)
        order, keep, n = [v for v, d in enumerate(degree) if not d], -1, sum(alive)
        while n:
            if m / n > best:
                best, keep = m / n, len(order)
            while not alive[heap[0][1]] or heap[0][0] != degree[heap[0][1]]:
                heapq.heappop(heap)
            least, batch = heap[0][0], []
            goes = lambda d: d <= least or d < best if epsilon is None else d <= 2 * (1 + epsilon) * (m / n)  # noqa: B023, E731
            while heap and goes(heap[0][0]):
                d, v = heapq.heappop(heap)
                if alive[v] and d == degree[v]:
                    alive[v] = False
                    batch.append(v)
            touched = set()
            for v in batch:
                for u in near[v]:
                    near[u].discard(v)
                    degree[u] -= 1
                    m -= 1
                    if alive[u]:
                        touched.add(u)
            lone = [u for u in touched if not degree[u]]
            for u in lone:
                alive[u] = False
            for u in touched.difference(lone):
                heapq.heappush(heap, (degree[u], u))
            order += batch + lone
            n -= len(batch) + len(lone)
        return _frame(g, order[keep:] if keep >= 0 else [])

    if one_task(graph, plan, SMALL):
        return run_local(graph, kernel, IDS)
    steps = Steps(graph.spark)
    e = steps.write(graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    best, keep = 0.0, graph.vertices.select("id").limit(0)
    while True:
        d = steps.write(e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
        n, ends, least = d.agg(F.count("*"), F.sum("d"), F.min("d")).first()
        if not n:
            return keep
        if plan == "auto" and n + ends // 2 <= SMALL:
            rest = Graph(d.select("id"), e.select(F.lit(0).cast("long").alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")))
            top = steps.write(run_local(rest, lambda g: kernel(g, best), IDS))
            return keep if top.isEmpty() else top
        density = ends / 2 / n
        if density > best:
            best, keep = density, d.select("id")
        stay = d.filter((F.col("d") > least) & (F.col("d") >= best) if epsilon is None else F.col("d") > 2 * (1 + epsilon) * density).select("id")
        e = steps.write(e.join(stay.toDF("a"), "a", "left_semi").join(stay.toDF("b"), "b", "left_semi"))


#: Elimination goes over to a table of adjacent pairs at this many neighbours, once so few vertices are left (in Java: once its bits fit the heap).
WIDE, TABLE = 32, 8192


def _eliminate(graph: Graph, fill: bool) -> tuple[int, list[int]]:
    """A vertex costs its neighbours, or the pairs of them that are not linked: pairs less the links counted around it.

    Links around a vertex are kept up to date, link by link that is filled in.  The same
    rule twice: in Java, or over sets and arrays where a session has no JVM of its own.
    """

    def kernel(g: LocalGraph) -> pd.DataFrame:
        near, order, width = _sets(g), [], 0
        links = [0] * g.n
        if fill:
            for a in range(g.n):
                for b in near[a]:
                    if a < b:
                        for x in near[a] & near[b]:
                            links[x] += 1

        def price(v: int) -> int:
            k = len(near[v])
            return k * (k - 1) // 2 - links[v] if fill else k

        cost = [price(v) for v in range(g.n)]
        gone = [False] * g.n
        heap = [(c, v) for v, c in enumerate(cost)]
        heapq.heapify(heap)
        while heap:
            c, v = heapq.heappop(heap)
            if gone[v] or c != cost[v]:
                continue
            around = near[v]
            if len(around) > WIDE and g.n - len(order) <= TABLE:
                rest = np.flatnonzero(~np.array(gone))
                more, wide = _eliminate_table(rest, near, np.array(links)[rest], fill)
                order += more
                width = max(width, wide)
                break
            width = max(width, len(around))
            gone[v] = True
            order.append(v)
            again = set(around)
            for a in around:
                near[a].discard(v)
                if fill:
                    links[a] -= len(near[a] & around)
            for a in around:
                for b in around - near[a]:
                    if b != a:
                        if fill:
                            both = near[a] & near[b]
                            links[a] += len(both)
                            links[b] += len(both)
                            for x in both:
                                links[x] += 1
                            again |= both
                        near[a].add(b)
                        near[b].add(a)
            for a in again:
                new = price(a)
                if new != cost[a]:
                    cost[a] = new
                    heapq.heappush(heap, (new, a))
        return pd.DataFrame({"pos": np.arange(len(order)), "id": g.ids[order] if order else np.zeros(0, np.int64), "width": width})

    java = register(graph.spark, "Elimination", "binary")
    if java:
        n = (F.octet_length("ids") / 8).cast("int")
        ids, done = run_local(graph, pack, PACKED).select("ids", F.call_function(java, n, F.lit(fill), F.lit(WIDE), "edges")).collect()[0]
        ids, done = np.frombuffer(ids, "<i8"), np.frombuffer(done, "<i4")
        return int(done[-1]), ids[done[:-1]].tolist()
    rows = run_local(graph, kernel, "pos long, id long, width long").orderBy("pos").collect()
    return (rows[0]["width"] if rows else 0), [r["id"] for r in rows]


def _eliminate_table(rest: np.ndarray, near: list[set[int]], links: np.ndarray, fill: bool) -> tuple[list[int], int]:
    """(order, width) of the vertices ``rest``, ascending, by the rule of :func:`_eliminate`, over a table of adjacent pairs."""
    m, order, width = len(rest), [], 0
    at = {int(v): i for i, v in enumerate(rest)}
    linked = np.zeros((m, m), bool)
    for i, v in enumerate(rest.tolist()):
        linked[i, [at[u] for u in near[v]]] = True
    degree, links = linked.sum(axis=1), links.astype(np.int64)
    there = np.ones(m, bool)
    never = np.iinfo(np.int64).max
    while len(order) < m:
        v = int(np.where(there, degree * (degree - 1) // 2 - links if fill else degree, never).argmin())
        k = np.flatnonzero(linked[v])
        width = max(width, len(k))
        there[v] = False
        order.append(int(rest[v]))
        linked[v] = linked[:, v] = False
        degree[k] -= 1
        inside = linked[np.ix_(k, k)]
        held = inside.sum(axis=1)
        links[k] -= held
        lacks = np.flatnonzero(held < len(k) - 1)
        if not len(lacks) and len(k) == m - len(order):
            # What is left is a clique: it goes by id.
            return order + rest[there].tolist(), width
        if fill:
            for a in k[lacks].tolist():
                b = k[~linked[a, k]]
                b = b[b != a]
                if not len(b):
                    continue
                both = linked[b] & linked[a]
                # Links among the new neighbours count around each of them and around a.
                among = linked[np.ix_(b, b)].sum(axis=1)
                shared = both.sum(axis=1)
                links += both.sum(axis=0)
                links[b] += shared + among
                links[a] += shared.sum() + among.sum() // 2
                linked[a, b] = linked[b, a] = True
                degree[a] += len(b)
                degree[b] += 1
        elif len(lacks):
            linked[np.ix_(k, k)] = True
            linked[k, k] = False
            degree[k] += len(k) - 1 - held
    return order, width


def treewidth_min_degree(graph: Graph) -> tuple[int, list[int]]:
    """(upper bound of the treewidth, elimination order) by least degree, ties to the lower id."""
    return _eliminate(graph, False)


def treewidth_min_fill_in(graph: Graph) -> tuple[int, list[int]]:
    """(upper bound of the treewidth, elimination order) by fewest edges to fill in, ties to the lower id."""
    return _eliminate(graph, True)


def greedy_tsp(graph: Graph, start: int) -> tuple[list[int], float]:
    """(closed tour, cost): always on to the nearest unvisited vertex by shortest path, ties to the lower id."""
    from ..plans.sources import dijkstra

    graph.require_nodes(start)

    def kernel(g: LocalGraph) -> pd.DataFrame:
        if union_find(g.n, g.src, g.dst).any():
            return pd.DataFrame()
        begin, ends, length = g.lists()
        free = not (np.asarray(length) > 0).all()
        at, tour, cost = g.pos(start), [g.pos(start)], 0.0
        left = [True] * g.n
        left[at] = False
        for _ in range(g.n - 1):
            # Only as far as the nearest one that is left, and all others at its distance.
            near, who, dist, heap = np.inf, -1, {at: 0.0}, [(0.0, at)]
            while heap and heap[0][0] <= near:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                if left[u]:
                    near, who = d, u if d < near or who < 0 else min(who, u)
                    if not free:
                        continue
                for arc in range(begin[u], begin[u + 1]):
                    v, e = ends[arc], d + length[arc]
                    if e <= near and e < dist.get(v, np.inf):
                        dist[v] = e
                        if left[v]:
                            near = e
                        elif e == near and not free:
                            continue
                        heapq.heappush(heap, (e, v))
            if who < 0:
                return pd.DataFrame()
            cost, at = cost + near, who
            tour.append(at)
            left[at] = False
        back = dijkstra(g, at)[0][tour[0]]
        if not np.isfinite(back):
            return pd.DataFrame()
        return pd.DataFrame({"pos": np.arange(len(tour) + 1), "id": g.ids[[*tour, tour[0]]], "cost": cost + back})

    if graph.node_count() < 2:
        raise InvalidGraph("a tour needs two vertices")
    rows = run_local(graph, kernel, "pos long, id long, cost double").orderBy("pos").collect()
    if not rows:
        raise AlgorithmError("not all vertices can be reached")
    return [r["id"] for r in rows], rows[0]["cost"]


def min_weighted_vertex_cover(graph: Graph) -> DataFrame:
    """(id) of a cover: always the vertex with most uncovered edges, ties to the higher id; both ends of a self-loop's edge are that vertex, which is taken."""

    def kernel(g: LocalGraph) -> pd.DataFrame:
        loops = set(g.src[g.src == g.dst].tolist())
        near, cover = _sets(g), set()
        degree = [len(x) + (v in loops) for v, x in enumerate(near)]
        heap = [(-d, -v) for v, d in enumerate(degree) if d]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            v = -v
            if v in cover or -d != degree[v] or not degree[v]:
                continue
            cover.add(v)
            for u in near[v]:
                if u not in cover:
                    degree[u] -= 1
                    if degree[u]:
                        heapq.heappush(heap, (-degree[u], -u))
            degree[v] = 0
        return _frame(g, cover)

    return run_local(graph, kernel, IDS)
