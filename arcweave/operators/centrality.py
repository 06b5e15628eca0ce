"""Centrality measures; one row (id, value) a vertex."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlgorithmError, ConvergenceFailed, InvalidArgument, InvalidGraph
from ..graph import Expr, Graph, column
from ..plans.local import LIMIT, LocalGraph, fits, one_task, run_local
from ..plans.sources import distance_sums, hops, per_source
from ..plans.tables import Steps
from .components import SMALL


def _ends(graph: Graph, *cols: str) -> DataFrame:
    ends = graph.edges.select(F.explode(F.array(*cols)).alias("id")) if len(cols) > 1 else graph.edges.select(F.col(cols[0]).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").cast("double").alias("degree"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def degree_centrality(graph: Graph) -> DataFrame:
    """(id, degree) as raw counts; a self-loop counts twice; directed: in plus out."""
    return _ends(graph, "src", "dst")


def in_degree_centrality(graph: Graph) -> DataFrame:
    return _ends(graph, "dst") if graph.directed else _ends(graph, "src", "dst")


def out_degree_centrality(graph: Graph) -> DataFrame:
    return _ends(graph, "src") if graph.directed else _ends(graph, "src", "dst")


def _require(graph: Graph) -> None:
    if graph.is_empty():
        raise InvalidGraph("the graph has no vertices")


def _require_lengths(graph: Graph) -> None:
    bad = graph.edges.filter("weight is not null and (isnan(weight) or weight < 0 or cast(weight as string) = '-0.0')")
    if not bad.isEmpty():
        raise InvalidArgument("distances need weights that are not negative nor NaN")


def closeness_centrality(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, closeness): r / S * r / (n - 1) over the r vertices at finite positive distance along out-arcs, S their sum of distances.

    A negative or NaN weight raises InvalidArgument.
    """
    _require(graph)
    _require_lengths(graph)
    d = distance_sums(graph, plan)
    n = graph.vertices.agg(F.count("*").alias("n"))
    value = F.when((F.col("s") > 0) & (F.col("n") > 1), F.col("r") / F.when(F.col("s") > 0, F.col("s")) * F.col("r") / F.when(F.col("n") > 1, F.col("n") - 1))
    return graph.vertices.select("id").join(d, "id", "left").crossJoin(F.broadcast(n)).select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def harmonic_centrality(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, harmonic): sum of 1 / distance to the others; infinite across a zero-weight way.

    A negative or NaN weight raises InvalidArgument.
    """
    _require_lengths(graph)
    inverse = F.when(F.col("z") > 0, F.lit(float("inf"))).otherwise(F.coalesce("h", F.lit(0.0)))
    s = distance_sums(graph, plan).select("id", inverse.alias("harmonic"))
    return graph.vertices.select("id").join(s, "id", "left").select("id", F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def _brandes(g: LocalGraph, at: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(dependency of each vertex, order, arc contributions (from, to, value)) of one source; hops, parallel arcs multiply paths."""
    start, to, _ = g.csr("out")
    depth, sigma = np.full(g.n, -1, np.int64), np.zeros(g.n)
    depth[at], sigma[at] = 0, 1.0
    levels, frontier, d = [], np.array([at]), 0
    while len(frontier):
        count = start[frontier + 1] - start[frontier]
        arc = np.repeat(start[frontier] - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())
        u, v = np.repeat(frontier, count), to[arc]
        new = depth[v] < 0
        depth[v[new]] = d + 1
        down = depth[v] == d + 1
        u, v = u[down], v[down]
        np.add.at(sigma, v, sigma[u])
        levels.append((u, v))
        frontier, d = np.unique(v), d + 1
    delta, parts = np.zeros(g.n), []
    for u, v in reversed(levels):
        if len(u):
            share = sigma[u] / sigma[v] * (1 + delta[v])
            np.add.at(delta, u, share)
            parts.append((u, v, share))
    delta[at] = 0.0
    return delta, sigma, parts


def _scale(n: int, normalized: bool, factor: float, undirected: float) -> float:
    if normalized:
        return factor / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return undirected


def _brandes_distributed(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(src, u, v, share) of all arcs on shortest paths, and (src, id, delta), by level joins keyed by source."""
    steps = Steps(graph.spark)
    arcs = steps.write(graph.arcs("out").filter("src <> dst").groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.count("*").cast("double").alias("k")))
    depth = hops(graph, plan="distributed")
    dag = depth.toDF("src", "u", "du").join(arcs, "u").join(depth.toDF("src", "v", "dv"), ["src", "v"]).filter("dv = du + 1")
    dag = steps.write(dag.select("src", "u", "v", "du", "k"))
    far = dag.agg(F.max("du")).first()[0]
    sigma = steps.write(depth.filter("depth = 0").select("src", "id", F.lit(1.0).alias("sigma")))
    for d in range(0, (far if far is not None else -1) + 1):
        up = dag.filter(F.col("du") == d).join(sigma.toDF("src", "u", "s"), ["src", "u"]).groupBy("src", F.col("v").alias("id")).agg(F.sum(F.col("s") * F.col("k")).alias("sigma"))
        sigma = steps.write(sigma.unionByName(up), replaces=sigma)
    empty = graph.spark.createDataFrame([], "src long, id long, delta double")
    delta, shares = empty, graph.spark.createDataFrame([], "src long, u long, v long, share double")
    for d in range(far if far is not None else -1, -1, -1):
        e = dag.filter(F.col("du") == d).join(sigma.toDF("src", "u", "su"), ["src", "u"]).join(sigma.toDF("src", "v", "sv"), ["src", "v"]).join(delta.toDF("src", "v", "dv"), ["src", "v"], "left")
        part = steps.write(e.select("src", "u", "v", (F.col("k") * F.col("su") / F.col("sv") * (1 + F.coalesce("dv", F.lit(0.0)))).alias("share")))
        delta = steps.write(delta.unionByName(part.groupBy("src", F.col("u").alias("id")).agg(F.sum("share").alias("delta"))))
        shares = shares.unionByName(part)
    return shares, delta


def betweenness_centrality(graph: Graph, normalized: bool = False, plan: str = "auto") -> DataFrame:
    """(id, betweenness) over shortest paths by hops; normalised by (n - 1)(n - 2), else halved if undirected."""
    _require(graph)
    if one_task(graph, plan, LIMIT):

        def kernel(g: LocalGraph, at: int) -> pd.DataFrame:
            delta, _, _ = _brandes(g, at)
            hit = np.flatnonzero(delta)
            return pd.DataFrame({"id": g.ids[hit], "delta": delta[hit]})

        parts = per_source(graph, kernel, "id long, delta double")
    else:
        parts = _brandes_distributed(graph)[1].filter("src <> id").select("id", "delta")
    c = _scale(graph.node_count(), normalized, 1.0, 1.0 if graph.directed else 0.5)
    s = parts.groupBy("id").agg((F.sum("delta") * c).alias("betweenness"))
    return graph.vertices.select("id").join(s, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def edge_betweenness_centrality(graph: Graph, normalized: bool = False, plan: str = "auto") -> DataFrame:
    """(u, v, betweenness) of every arc; undirected edges have a row each way, each with its own way's paths, not halved."""
    _require(graph)
    if one_task(graph, plan, LIMIT):

        def kernel(g: LocalGraph, at: int) -> pd.DataFrame | None:
            parts = _brandes(g, at)[2]
            if not parts:
                return None
            u, v, s = (np.concatenate(x) for x in zip(*parts))
            return pd.DataFrame({"u": g.ids[u], "v": g.ids[v], "share": s})

        parts = per_source(graph, kernel, "u long, v long, share double")
    else:
        parts = _brandes_distributed(graph)[0].select("u", "v", "share")
    c = _scale(graph.node_count(), normalized, 1.0 if graph.directed else 2.0, 1.0)
    s = parts.groupBy("u", "v").agg((F.sum("share") * c).alias("betweenness"))
    all_arcs = graph.neighbour_pairs("out").toDF("u", "v")
    return all_arcs.join(s, ["u", "v"], "left").select("u", "v", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


# --------------------------------------------------------------------------- power iterations


def _iterate(graph: Graph, arcs: DataFrame, start: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, Column | None]], residual: Column, max_iter: int, tol: float, every: int = 4) -> tuple[DataFrame, bool]:
    """State (id, x, ...) replaced by ``step(state, sums)`` until ``residual`` over (x, old) is below tol.

    ``sums`` has (id, s), the weighted sums over ``arcs`` (from, to, w).  Each step is
    one join and one aggregation; the residual is one row.
    """
    steps = Steps(graph.spark)
    arcs = steps.write(arcs.repartition("from"))
    state = steps.write(start)
    for _ in range(max_iter):
        sums = arcs.join(state.select(F.col("id").alias("from"), "x"), "from").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        new = steps.write(step(state, sums))
        left = new.agg(residual).first()[0]
        steps.drop(state)
        state = new
        if left is not None and left < tol:
            return state, True
    return state, False


def _transition(graph: Graph, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """((from, to, w), (id, out)): arcs with their share of the weight that leaves a vertex; zero-weight vertices dangle."""
    a = graph.arcs("flow").select("src", "dst", F.col("weight").cast("double").alias("weight") if weighted else F.lit(1.0).alias("weight"))
    out = a.groupBy("src").agg(F.sum("weight").alias("out"))
    arcs = a.join(out, "src").filter("out <> 0").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("w"))
    return arcs, out.toDF("id", "out")


def _pagerank(graph: Graph, damping: float, max_iter: int, tol: float, start: np.ndarray | DataFrame | None, p: DataFrame | None, weighted: bool, norm: str, plan: str, zero_start: str) -> DataFrame:
    if not 0 <= damping <= 1:
        raise InvalidArgument("damping must lie in [0, 1]")
    if one_task(graph, plan, SMALL):
        given = {r["id"]: r["value"] for r in start.collect()} if start is not None else None
        pers = {r["id"]: r["value"] for r in p.collect()} if p is not None else None

        def kernel(g: LocalGraph) -> pd.DataFrame:
            n = g.n
            if not n:
                return pd.DataFrame()
            s, d, w = g.arcs("flow")
            w = w if weighted else np.ones(len(s))
            out = np.bincount(s, w, n)
            ok = out[s] != 0
            s, d, share = s[ok], d[ok], w[ok] / out[s[ok]]
            dangling = out == 0
            x = np.full(n, 1 / n)
            if given is not None:
                v = np.array([given.get(int(i), 0.0) for i in g.ids])
                x = v / v.sum() if v.sum() else x
            q = np.full(n, 1 / n)
            if pers is not None:
                v = np.array([pers.get(int(i), 0.0) for i in g.ids])
                q = v / v.sum() if v.sum() > 0 else q
                x = q if given is None else x
            for _ in range(max_iter):
                new = (1 - damping) * q + damping * (np.bincount(d, share * x[s], n) + x[dangling].sum() * q)
                diff = np.abs(new - x)
                x = new
                if (diff.sum() if norm == "l1" else diff.max()) < tol:
                    break
            return pd.DataFrame({"id": g.ids, "pagerank": x})

        return run_local(graph, kernel, "id long, pagerank double")
    n = graph.node_count()
    arcs, out = _transition(graph, weighted)
    base = graph.vertices.select("id").join(out, "id", "left").withColumn("dangling", F.coalesce(F.col("out") == 0, F.lit(True)))

    def normalized(v: DataFrame | None, name: str, df: DataFrame) -> DataFrame:
        if v is None:
            return df.withColumn(name, F.lit(1 / n))
        total = v.agg(F.sum("value")).first()[0] or 0.0
        return df.join(v.select("id", F.col("value").alias(name)), "id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)) / total if total > 0 else F.lit(1 / n))

    state = normalized(p, "q", base)
    state = state.withColumn("x", F.col("q")) if start is None else normalized(start, "x", state)
    steps = Steps(graph.spark)

    def step(old: DataFrame, sums: DataFrame) -> DataFrame:
        lost = old.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0))).first()[0]
        new = (1 - damping) * F.col("q") + damping * (F.coalesce("s", F.lit(0.0)) + lost * F.col("q"))
        return old.join(sums, "id", "left").select("id", "q", "dangling", new.alias("x"), F.col("x").alias("old"))

    diff = F.abs(F.col("x") - F.col("old"))
    steps.drop(None)
    result, _ = _iterate(graph, arcs, state.select("id", "q", "dangling", "x"), step, F.sum(diff) if norm == "l1" else F.max(diff), max_iter, tol)
    return result.select("id", F.col("x").alias("pagerank"))


def pagerank(graph: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, nstart: DataFrame | None = None, plan: str = "auto") -> DataFrame:
    """(id, pagerank): weighted; dangling mass spread evenly; stops at an L1 change below tol, or after max_iter without error.

    ``nstart`` (id, value) is normalised; a sum of 0 raises.
    """
    if nstart is not None and abs(nstart.agg(F.sum("value")).first()[0] or 0.0) < 1e-300:
        raise InvalidArgument("the start vector sums to 0")
    return _pagerank(graph, damping, max_iter, tol, nstart, None, True, "l1", plan, "raise")


def personalized_pagerank(graph: Graph, personalization: DataFrame | None = None, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100, plan: str = "auto") -> DataFrame:
    """(id, pagerank) with restarts, and dangling mass, by ``personalization`` (id, value); a sum of at most 0 is even."""
    _require(graph)
    if not 0 < damping < 1 or max_iter <= 0:
        raise InvalidArgument("damping must lie in (0, 1) and max_iter be positive")
    return _pagerank(graph, damping, max_iter, tol, None, personalization, True, "l1", plan, "even")


def pagerank_unweighted(graph: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, nstart: DataFrame | None = None, plan: str = "auto") -> DataFrame:
    """(id, pagerank): weights ignored, stops at a largest change below tol; a start of sum 0 is even."""
    return _pagerank(graph, damping, max_iter, tol, nstart, None, False, "linf", plan, "even")


def personalized_pagerank_vec(graph: Graph, personalization: Sequence[float] | None = None, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> list[float]:
    """As :func:`personalized_pagerank`, values in and out as lists by ascending id; for graphs that one task takes."""
    if not fits(graph, LIMIT):
        raise AlgorithmError(f"the graph has more than {LIMIT} vertices and edges, too many for a list")
    p = None
    if personalization is not None:
        ids = [r["id"] for r in graph.vertices.select("id").orderBy("id").collect()]
        if len(ids) != len(personalization):
            raise InvalidArgument("one value a vertex is needed")
        p = graph.spark.createDataFrame([(i, float(x)) for i, x in zip(ids, personalization)], "id long, value double")
    return [r["pagerank"] for r in personalized_pagerank(graph, p, damping, tol, max_iter).orderBy("id").collect()]


def katz_centrality(graph: Graph, alpha: float = 0.1, beta: Expr | None = None, max_iter: int = 1000, tol: float = 1e-6, plan: str = "auto") -> DataFrame:
    """(id, katz): x = alpha A x + beta from 0, summed over out-neighbours, not normalised; raises unless it settles (L2)."""
    b = F.lit(1.0) if beta is None else column(beta).cast("double")
    if one_task(graph, plan, SMALL):
        bias = None if beta is None else {r["id"]: r["b"] for r in graph.vertices.select("id", b.alias("b")).collect()}

        def kernel(g: LocalGraph) -> pd.DataFrame:
            s, d, w = g.arcs("out")
            base = np.ones(g.n) if bias is None else np.array([bias[int(i)] for i in g.ids])
            x = np.zeros(g.n)
            for _ in range(max_iter):
                new = alpha * np.bincount(s, w * x[d], g.n) + base
                diff = np.sqrt(((new - x) ** 2).sum())
                x = new
                if diff < tol:
                    return pd.DataFrame({"id": g.ids, "katz": x})
            return pd.DataFrame({"id": g.ids, "katz": np.full(g.n, np.nan)})

        out = Steps(graph.spark).write(run_local(graph, kernel, "id long, katz double"))
        if not out.filter("katz is null or isnan(katz)").isEmpty():
            raise ConvergenceFailed(max_iter, "Katz centrality did not settle")
        return out
    arcs = graph.arcs("out").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("weight").cast("double").alias("w"))
    start = graph.vertices.select("id", b.alias("b"), F.lit(0.0).alias("x"))

    def step(old: DataFrame, sums: DataFrame) -> DataFrame:
        return old.join(sums, "id", "left").select("id", "b", (F.lit(alpha) * F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("x"), F.col("x").alias("old"))

    out, done = _iterate(graph, arcs, start, step, F.sqrt(F.sum(F.pow(F.col("x") - F.col("old"), 2))), max_iter, tol)
    if not done:
        raise ConvergenceFailed(max_iter, "Katz centrality did not settle")
    return out.select("id", F.col("x").alias("katz"))


def eigenvector_centrality(graph: Graph, max_iter: int = 1000, tol: float = 1e-6, plan: str = "auto") -> DataFrame:
    """(id, eigenvector), summing to n: power iteration on A + I (undirected) or in-arcs (directed).

    Even values without edges or where the vector vanishes; raises unless it settles (L2).
    """
    directed = graph.directed
    if one_task(graph, plan, SMALL):

        def kernel(g: LocalGraph) -> pd.DataFrame:
            s, d, w = g.arcs("flow")
            even = pd.DataFrame({"id": g.ids, "eigenvector": np.full(g.n, 1 / max(1, g.n))})
            if not len(s):
                return even
            x = np.full(g.n, 1 / np.sqrt(g.n))
            for k in range(max_iter):
                y = np.bincount(d, w * x[s], g.n) + (0 if directed else x)
                size = np.sqrt((y * y).sum())
                if size < 1e-10:
                    return even
                y /= size
                diff = np.sqrt(((y - x) ** 2).sum())
                if directed and k > 10:
                    diff = min(diff, np.sqrt(((y + x) ** 2).sum()))
                x = y
                if diff < tol:
                    a = np.abs(x)
                    return pd.DataFrame({"id": g.ids, "eigenvector": a * g.n / a.sum()})
            return pd.DataFrame({"id": g.ids, "eigenvector": np.full(g.n, np.nan)})

        out = Steps(graph.spark).write(run_local(graph, kernel, "id long, eigenvector double"))
        if not out.filter("eigenvector is null or isnan(eigenvector)").isEmpty():
            raise ConvergenceFailed(max_iter, "eigenvector centrality did not settle")
        return out
    n = graph.node_count()
    even = graph.vertices.select("id", F.lit(1 / max(1, n)).alias("eigenvector"))
    if graph.edges.isEmpty():
        return even
    steps = Steps(graph.spark)
    arcs = steps.write(graph.arcs("flow").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("weight").cast("double").alias("w")).repartition("from"))
    x = before = steps.write(graph.vertices.select("id", F.lit(n**-0.5).alias("x")))
    for k in range(max_iter):
        s = arcs.join(x.select(F.col("id").alias("from"), "x"), "from").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        y = F.coalesce("s", F.lit(0.0)) + (F.lit(0.0) if directed else F.col("x"))
        new = steps.write(x.join(s, "id", "left").select("id", y.alias("y"), F.col("x").alias("old")))
        steps.drop(before)
        before = new
        size = new.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if size < 1e-10:
            return even
        z = F.col("y") / size
        plus, minus = new.agg(F.sqrt(F.sum(F.pow(z - F.col("old"), 2))), F.sqrt(F.sum(F.pow(z + F.col("old"), 2)))).first()
        x = new.select("id", z.alias("x"))
        if plus < tol or directed and k > 10 and minus < tol:
            total = x.agg(F.sum(F.abs("x"))).first()[0]
            return x.select("id", (F.abs("x") * n / total).alias("eigenvector"))
    raise ConvergenceFailed(max_iter, "eigenvector centrality did not settle")


# --------------------------------------------------------------------------- reach, votes, Laplacian


def local_reaching_centrality(graph: Graph, distance: int, plan: str = "auto") -> DataFrame:
    """(id, reach): vertices within ``distance`` hops, itself included."""
    return hops(graph, most=distance, plan=plan).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("reach"))


def global_reaching_centrality(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, reach): vertices reachable, itself included."""
    return hops(graph, plan=plan).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("reach"))


def voterank(graph: Graph, num_seeds: int) -> DataFrame:
    """(rank, id) of the elected, first to last; ties to the lower id; ends when no votes are left.

    Vertices vote along their out-arcs.  The elected vertex's (out-)neighbours lose one
    over the mean (in-)degree of their ability, for each edge to them.  Votes are
    compared to nine digits.
    """

    def kernel(g: LocalGraph) -> pd.DataFrame:
        s, d, _ = g.arcs("flow")
        if not len(s):
            return pd.DataFrame()
        start, to, _ = g.csr("out")
        loss = g.n / len(to)
        ability, elected = np.ones(g.n), []
        taken = np.zeros(g.n, bool)
        for _ in range(min(num_seeds, g.n)):
            score = np.round(np.bincount(d, ability[s], g.n), 9)
            score[taken] = -1
            best = int(score.argmax())
            if score[best] <= 0:
                break
            elected.append(best)
            taken[best], ability[best] = True, 0.0
            for v in to[start[best] : start[best + 1]].tolist():
                ability[v] = max(0.0, ability[v] - loss)
        return pd.DataFrame({"rank": np.arange(len(elected)), "id": g.ids[elected]})

    return run_local(graph, kernel, "rank long, id long")


def laplacian_centrality(graph: Graph) -> DataFrame:
    """(id, laplacian): d**2 + d + 2 * sum of the neighbours' degrees, d counting (out-)neighbours."""
    d = graph.out_degrees().toDF("id", "d")
    s = graph.arcs("out").join(d.toDF("dst", "dn"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("dn").alias("s"))
    return d.join(s, "id", "left").select("id", (F.col("d") * F.col("d") + F.col("d") + 2 * F.coalesce("s", F.lit(0))).cast("double").alias("laplacian"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores of an (id, score) table, ties to the lower id."""
    if k < 0:
        raise AlgorithmError("k must not be negative")
    return scores.orderBy(F.col(scores.columns[1]).desc(), scores.columns[0]).limit(k)
