"""Seeded and regular graphs. Random choices depend on the seed and the vertices only, never on partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.draws import uniform
from ..graph import Graph
from ..plans.tables import indexed


def _graph(spark: SparkSession, n: int, e: DataFrame, directed: bool, attr: int | None = None, weight: float = 1.0) -> Graph:
    v = spark.range(n).select("id", F.col("id").alias("attr") if attr is None else F.lit(attr).cast("long").alias("attr"))
    return Graph(v, e.withColumn("weight", F.lit(float(weight))).select("eid", "src", "dst", "weight"), directed)


def _positive(n: int, least: int = 1) -> None:
    if n < least:
        raise InvalidArgument(f"at least {least} vertices are needed")


def _pairs(spark: SparkSession, n: int, directed: bool) -> DataFrame:
    """All ordered or unordered pairs; eid = src * n + dst.  Sources are spread over tasks, targets come from a sequence."""
    j = F.sequence(F.lit(0).cast("long") if directed else F.col("src") + 1, F.lit(n - 1).cast("long"))
    rows = spark.range(n).select(F.col("id").alias("src")).filter(F.lit(True) if directed else F.col("src") < n - 1)
    rows = rows.select("src", F.explode(j).alias("dst")).filter("src <> dst")
    return rows.select((F.col("src") * n + F.col("dst")).alias("eid"), "src", "dst")


def _probability(p: float) -> None:
    if not 0 <= p <= 1:
        raise InvalidArgument("a probability lies in [0, 1]")


def erdos_renyi_graph(spark: SparkSession, n: int, p: float, seed: int = 0, directed: bool = False) -> Graph:
    """Each pair an edge with probability p, by an md5 draw of seed and pair."""
    _positive(n)
    _probability(p)
    return _graph(spark, n, _pairs(spark, n, directed).filter(uniform(seed, "src", "dst") < p), directed)


def complete_graph(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    _positive(n)
    return _graph(spark, n, _pairs(spark, n, directed), directed)


def bipartite_graph(spark: SparkSession, n1: int, n2: int, p: float, seed: int = 0, directed: bool = False) -> Graph:
    """Vertices 0 to n1 - 1 and n1 to n1 + n2 - 1; edges run from the first group to the second."""
    _positive(n1)
    _positive(n2)
    _probability(p)
    e = spark.range(n1).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(n1).cast("long"), F.lit(n1 + n2 - 1).cast("long"))).alias("dst"))
    e = e.select((F.col("src") * (n1 + n2) + F.col("dst")).alias("eid"), "src", "dst").filter(uniform(seed, "src", "dst") < p)
    return _graph(spark, n1 + n2, e, directed)


def _ring(spark: SparkSession, m: int, src: Column, dst: Column) -> DataFrame:
    return spark.range(m).select(F.col("id").alias("eid"), src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def star_graph(spark: SparkSession, n: int, directed: bool = False, attr: int | None = None, weight: float = 1.0) -> Graph:
    """Vertex 0 to each other one."""
    _positive(n)
    return _graph(spark, n, _ring(spark, n - 1, F.lit(0), F.col("id") + 1), directed, attr, weight)


def path_graph(spark: SparkSession, n: int, directed: bool = False, attr: int | None = None, weight: float = 1.0) -> Graph:
    _positive(n)
    return _graph(spark, n, _ring(spark, n - 1, F.col("id"), F.col("id") + 1), directed, attr, weight)


def cycle_graph(spark: SparkSession, n: int, directed: bool = False, least: int = 3, attr: int | None = None, weight: float = 1.0) -> Graph:
    _positive(n, least)
    return _graph(spark, n, _ring(spark, n, F.col("id"), (F.col("id") + 1) % n), directed, attr, weight)


def grid_graph(spark: SparkSession, rows: int, cols: int, attr: int | None = None, weight: float = 1.0) -> Graph:
    """Vertex r * cols + c; edges to the right and down."""
    _positive(rows)
    _positive(cols)
    at = spark.range(rows * cols).select(F.col("id").alias("src"))
    right = at.filter(F.col("src") % cols < cols - 1).select((2 * F.col("src")).alias("eid"), "src", (F.col("src") + 1).alias("dst"))
    down = at.filter(F.col("src") < (rows - 1) * cols).select((2 * F.col("src") + 1).alias("eid"), "src", (F.col("src") + cols).alias("dst"))
    return _graph(spark, rows * cols, right.unionByName(down), False, attr, weight)


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """Vertex i > 0 hangs on one of 0 to i - 1."""
    _positive(n)
    e = spark.range(1, n).select((F.col("id") - 1).alias("eid"), F.least(F.floor(uniform(seed, "id") * F.col("id")).cast("long"), F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    return _graph(spark, n, e, False)


def _kernel(spark: SparkSession, build, schema: str = "eid long, src long, dst long") -> DataFrame:
    def run(frames):
        for _ in frames:
            pass
        yield build()

    return spark.range(1).repartition(1).mapInPandas(run, schema)


def watts_strogatz_graph(spark: SparkSession, n: int, k: int, beta: float, seed: int = 0, directed: bool = False) -> Graph:
    """A ring of k nearest neighbours whose edges are rewired one after another with probability beta; one task's work."""
    _positive(n)
    _probability(beta)
    if k % 2 or k >= n or k < 0:
        raise InvalidArgument("k must be even and below n")

    def build() -> pd.DataFrame:
        r = np.random.default_rng(seed)
        edges = [(i, (i + j) % n) for i in range(n) for j in range(1, k // 2 + 1)]
        there = {(min(e), max(e)) for e in edges}
        out = []
        for a, b in edges:
            if r.random() < beta:
                for c in r.integers(0, n, 2 * n).tolist():
                    if c != a and (min(a, c), max(a, c)) not in there:
                        there.discard((min(a, b), max(a, b)))
                        there.add((min(a, c), max(a, c)))
                        b = c
                        break
            out.append((a, b))
        e = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"eid": np.arange(len(e)), "src": e[:, 0], "dst": e[:, 1]})

    return _graph(spark, n, _kernel(spark, build), directed)


def barabasi_albert_graph(spark: SparkSession, n: int, m: int, seed: int = 0, directed: bool = False) -> Graph:
    """Grown from a complete graph of m vertices: each new one links to m others, chosen by degree; one task's work."""
    if m < 1 or m >= n:
        raise InvalidArgument("m must lie between 1 and n - 1")

    def build() -> pd.DataFrame:
        r = np.random.default_rng(seed)
        edges = [(i, j) for i in range(m) for j in range(i + 1, m)]
        ends = [x for e in edges for x in e] or [0]
        for v in range(m, n):
            chosen: set[int] = set()
            tries = 0
            while len(chosen) < m and tries < 100 * m:
                chosen.add(ends[int(r.integers(len(ends)))])
                tries += 1
            for u in range(v):
                if len(chosen) >= m:
                    break
                chosen.add(u)
            for u in sorted(chosen):
                edges.append((v, u))
                ends += [v, u]
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"eid": np.arange(len(e)), "src": e[:, 0], "dst": e[:, 1]})

    return _graph(spark, n, _kernel(spark, build), directed)


def from_edge_pairs(pairs: DataFrame, directed: bool = False) -> Graph:
    """From a table (src, dst), eids in that order."""
    return Graph.from_edges(indexed(pairs.select("src", "dst"), ["src", "dst"], "eid"), directed)
