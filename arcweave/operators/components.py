"""Connected, weakly and strongly connected components; bipartiteness; acyclicity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.local import LocalGraph, one_task, run_local
from ..plans.tables import Steps, indexed

#: Graphs up to this size run as one task under ``plan="auto"``.
SMALL = 300_000


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of each position's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def star_table(links: DataFrame, steps: Steps) -> DataFrame:
    """(a, b): every node with a link and the least one reachable, without the components' least nodes themselves.

    Alternating large-star and small-star.  ``links``: a, b (of one orderable type);
    rows with a = b or a null are of no effect.  Each step is an aggregation (partial on
    the map side) and a join, so no task ever holds all neighbours of one node; every
    round is written, counted and hashed while it is.
    """

    def write(e: DataFrame, old: DataFrame | None):
        seen = Observation()
        hashed = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "a", "b")), F.lit(0)).alias(k) for k in ("x", "y")]
        out = steps.write(e.observe(seen, F.count("*").alias("n"), *hashed), replaces=old)
        return out, tuple(seen.get[k] for k in ("n", "x", "y"))

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table, state = write(edges, None)
    while state[0]:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        table, now = write(small, table)
        if now == state:
            break
        state = now
    return table


def star_labels(nodes: DataFrame, links: DataFrame, steps: Steps) -> DataFrame:
    """(id, component): least id reachable over links (a, b), its own without any."""
    table = star_table(links, steps)
    return nodes.select("id").join(table.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, component): least id of the component; direction is ignored, isolated nodes are components."""
    if one_task(graph, plan, SMALL):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            return pd.DataFrame({"id": g.ids, "component": g.ids[union_find(g.n, g.src, g.dst)]})

        return run_local(graph, kernel, "id long, component long")
    return star_labels(graph.vertices, graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Steps(graph.spark))


weakly_connected_components = connected_components


def component_lists(labels: DataFrame) -> DataFrame:
    """(component, size, members) by component; ``members`` ascending."""
    return labels.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members")).orderBy("component")


def connected_components_map(graph: Graph) -> DataFrame:
    """(id, component) with components numbered 0, 1, ... by their least ids."""
    labels = connected_components(graph)
    labels = Steps(graph.spark).write(labels)
    heads = indexed(labels.select("component").distinct(), ["component"], "k")
    return labels.join(heads, "component").select("id", F.col("k").alias("component"))


def strongly_connected_components(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, component): least id of the strongly connected component.

    Distributed: vertices without in- or out-arcs are trimmed; least ids flow forward
    along arcs, and those that reach back to their colour's vertex within the colour
    form a component; the rest goes on.
    """
    if not graph.directed:
        return connected_components(graph, plan)
    if one_task(graph, plan, SMALL):
        return run_local(graph, _scc_kernel, "id long, component long")
    steps = Steps(graph.spark)
    arcs = steps.write(graph.neighbour_pairs("out", loops=False))
    left = steps.write(graph.vertices.select("id"))
    done: DataFrame | None = None
    while not left.isEmpty():
        inner = steps.write(arcs.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
        colour = _flow(left.withColumn("c", F.col("id")), inner, steps, same=False)
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.filter("id = c")
        reach = _flow(roots, back, steps, same=True, colours=colour)
        found = reach.select("id", F.col("c").alias("component"))
        done = steps.write(found if done is None else done.unionByName(found))
        left = steps.write(left.join(found, "id", "left_anti"))
    return done if done is not None else graph.vertices.select("id", F.col("id").alias("component"))


def _flow(state: DataFrame, arcs: DataFrame, steps: Steps, same: bool, colours: DataFrame | None = None) -> DataFrame:
    """(id, c): least c that reaches each vertex; with ``same`` only within a colour."""
    state = steps.write(state)
    while True:
        moved = arcs.join(state.toDF("src", "c"), "src").select(F.col("dst").alias("id"), "c")
        if same:
            moved = moved.join(colours.toDF("id", "own"), "id").filter("own = c").select("id", "c")
        seen = Observation()
        new = state.unionByName(moved).groupBy("id").agg(F.min("c").alias("c"))
        new = new.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id", "c")), F.lit(0)).alias("x"))
        before = state.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("id", "c")), F.lit(0))).first()
        new = steps.write(new)
        if (seen.get["n"], seen.get["x"]) == tuple(before):
            return new
        state = new


def _scc_kernel(g: LocalGraph) -> pd.DataFrame:
    """Kosaraju: finishing order forward, then searches backward."""
    begin, to, _ = g.csr("out")
    seen, order = np.zeros(g.n, bool), []
    for s in range(g.n):
        if seen[s]:
            continue
        seen[s] = True
        stack = [(s, begin[s])]
        while stack:
            u, k = stack.pop()
            while k < begin[u + 1] and seen[to[k]]:
                k += 1
            if k == begin[u + 1]:
                order.append(u)
            else:
                stack.append((u, k + 1))
                seen[to[k]] = True
                stack.append((to[k], begin[to[k]]))
    begin, to, _ = g.csr("in")
    comp = np.full(g.n, -1, np.int64)
    for s in reversed(order):
        if comp[s] >= 0:
            continue
        members, stack = [s], [s]
        comp[s] = s
        while stack:
            u = stack.pop()
            for v in to[begin[u] : begin[u + 1]].tolist():
                if comp[v] < 0:
                    comp[v] = s
                    members.append(v)
                    stack.append(v)
        comp[members] = min(members)
    return pd.DataFrame({"id": g.ids, "component": g.ids[comp] if g.n else g.ids})


def count_components(graph: Graph) -> int:
    return connected_components(graph).select("component").distinct().count()


def is_connected(graph: Graph) -> bool:
    """Weakly connected; the empty graph isn't."""
    return count_components(graph) == 1


def bipartition(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, component, odd): components of the double cover tell sides and odd cycles.

    ``odd`` is true in components with a cycle of odd length; direction is ignored.
    Each vertex x stands as 2 x and 2 x + 1 (ids must lie within 2**62).
    """
    e = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    cover = e.select((2 * F.col("u")).alias("a"), (2 * F.col("v") + 1).alias("b")).unionByName(e.select((2 * F.col("u") + 1).alias("a"), (2 * F.col("v")).alias("b")))
    nodes = graph.vertices.select(F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("id"))
    double = Graph(nodes.withColumn("attr", F.lit(0).cast("long")), cover.select(F.monotonically_increasing_id().alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")))
    labels = connected_components(double, plan)
    by = labels.groupBy(F.floor(F.col("id") / 2).cast("long").alias("id")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.pmod("id", F.lit(2)) == 0, F.col("component"))).alias("even"))
    return by.select("id", F.floor(F.col("lo") / 2).cast("long").alias("component"), (F.col("lo") == F.col("hi")).alias("odd"), (F.col("even") != F.col("lo")).cast("int").alias("side"))


def is_bipartite(graph: Graph) -> bool:
    """No odd cycle; the empty graph is bipartite."""
    return bipartition(graph).filter("odd").isEmpty()


def acyclic_rest(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id) of vertices left after repeatedly taking away those without in-arcs: none exactly for a DAG.

    An undirected edge is an arc each way, so its ends and what hangs between them stay.
    """
    if one_task(graph, plan, SMALL):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            s, d, _ = g.arcs("out")
            degree = np.bincount(d, minlength=g.n)
            begin, to, _ = g.csr("out")
            ready, gone = np.flatnonzero(degree == 0).tolist(), 0
            while ready:
                u = ready.pop()
                gone += 1
                for v in to[begin[u] : begin[u + 1]].tolist():
                    degree[v] -= 1
                    if not degree[v]:
                        ready.append(v)
            return pd.DataFrame({"id": g.ids[degree > 0]})

        return run_local(graph, kernel, "id long")
    steps = Steps(graph.spark)
    left, arcs = steps.write(graph.vertices.select("id")), steps.write(graph.neighbour_pairs("out"))
    while True:
        top = left.join(arcs.select(F.col("dst").alias("id")), "id", "left_anti")
        if top.isEmpty():
            return left
        left = steps.write(left.join(arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"), replaces=left)
        arcs = steps.write(arcs.join(left.toDF("src"), "src", "left_semi"), replaces=arcs)


def is_dag(graph: Graph) -> bool:
    """Directed: no cycle. Undirected: no edges."""
    return acyclic_rest(graph).isEmpty() if graph.directed else graph.edges.isEmpty()
