"""Minimum spanning forests; direction is ignored and (weight, edge id) orders the edges, so the forest is unique."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidGraph
from ..graph import Graph
from ..plans.local import LIMIT, LocalGraph, fits, one_task, run_local
from ..plans.tables import Steps
from .components import SMALL, star_labels

TREE = "eid long, u long, v long, weight double"


def boruvka_mst(graph: Graph, plan: str = "auto") -> DataFrame:
    """(eid, u, v, weight) of the forest.

    Distributed: every component takes its least edge to another one; components that
    meet are merged by star steps; at most log2 n rounds.
    """
    if graph.is_empty():
        raise InvalidGraph("the graph has no vertices")
    if one_task(graph, plan, SMALL):
        return _kruskal(graph)
    steps = Steps(graph.spark)
    label = steps.write(graph.vertices.select("id", F.col("id").alias("component")))
    edges = steps.write(graph.edges.filter("src <> dst").select("eid", F.col("src").alias("u"), F.col("dst").alias("v"), "weight"))
    tree: DataFrame | None = None
    while True:
        lu, lv = label.toDF("u", "cu"), label.toDF("v", "cv")
        cut = steps.write(edges.join(lu, "u").join(lv, "v").filter("cu <> cv"))
        if cut.isEmpty():
            break
        e = F.struct("weight", "eid", "u", "v", "cu", "cv")
        ends = cut.select(F.col("cu").alias("c"), e.alias("e")).unionByName(cut.select(F.col("cv").alias("c"), e.alias("e")))
        best = steps.write(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen = best.select("eid", "u", "v", "weight")
        tree = chosen if tree is None else tree.unionByName(chosen)
        merged = star_labels(label.select(F.col("component").alias("id")).distinct(), best.select(F.col("cu").alias("a"), F.col("cv").alias("b")), Steps(graph.spark))
        label = steps.write(label.join(merged.toDF("component", "c"), "component").select("id", F.col("c").alias("component")), replaces=label)
        edges = cut.select("eid", "u", "v", "weight")
    return tree if tree is not None else graph.spark.createDataFrame([], TREE)


def kruskal_mst(graph: Graph) -> DataFrame:
    """(eid, u, v, weight) of the forest: edges in order, in one task; beyond what one task takes by rounds, with the same result."""
    if graph.is_empty():
        raise InvalidGraph("the graph has no vertices")
    return _kruskal(graph) if fits(graph, LIMIT) else boruvka_mst(graph, "distributed")


def _kruskal(graph: Graph) -> DataFrame:
    def kernel(g: LocalGraph) -> pd.DataFrame:
        order = np.lexsort((g.eid, g.weight))
        root = list(range(g.n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep = []
        for k in order.tolist():
            a, b = find(int(g.src[k])), find(int(g.dst[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                keep.append(k)
        return pd.DataFrame({"eid": g.eid[keep], "u": g.ids[g.src[keep]], "v": g.ids[g.dst[keep]], "weight": g.weight[keep]})

    return run_local(graph, kernel, TREE)


prim_mst = boruvka_mst


def mst_summary(tree: DataFrame) -> DataFrame:
    """One row: edges, total."""
    return tree.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))


def mst_with_total(graph: Graph) -> tuple[float, DataFrame]:
    """(total weight, forest)."""
    tree = Steps(graph.spark).write(boruvka_mst(graph))
    return mst_summary(tree).first()["total"], tree
