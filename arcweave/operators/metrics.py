"""Structural measures of whole graphs and of single nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.sources import hops


def oriented(graph: Graph) -> DataFrame:
    """Distinct undirected edges without loops, from the end of lower (degree, id): no vertex keeps more than about sqrt(2 m) arcs."""
    e = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    d = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    r = e.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    return r.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))


def triangle_list(graph: Graph) -> DataFrame:
    """(x, y, z) of each triangle once."""
    o = oriented(graph)
    wedge = o.join(o.toDF("x", "z"), "x").filter("y <> z")
    return wedge.join(o.toDF("y", "z"), ["y", "z"]).select("x", "y", "z")


def triangles(graph: Graph) -> DataFrame:
    """(id, triangles) of every vertex; direction and parallel edges are ignored."""
    t = triangle_list(graph).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return graph.vertices.select("id").join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def clustering_coefficients(graph: Graph) -> DataFrame:
    """(id, clustering): triangles over neighbour pairs; 0 below two neighbours (parallel edges count as neighbours)."""
    k = graph.arcs("sym").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    c = F.when(F.col("k") >= 2, 2.0 * F.col("triangles") / F.when(F.col("k") >= 2, F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return triangles(graph).join(k, "id", "left").select("id", F.coalesce(c, F.lit(0.0)).alias("clustering"))


def clustering_coefficient(graph: Graph, node: int) -> float:
    graph.require_nodes(node)
    return clustering_coefficients(graph).filter(F.col("id") == node).first()["clustering"]


def triangles_of(graph: Graph, node: int) -> int:
    graph.require_nodes(node)
    return triangles(graph).filter(F.col("id") == node).first()["triangles"]


def average_clustering_frame(graph: Graph) -> DataFrame:
    """One row: mean clustering over all vertices (0 for none)."""
    return clustering_coefficients(graph).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("average_clustering"))


def average_clustering_coefficient(graph: Graph) -> float:
    return average_clustering_frame(graph).first()[0]


def transitivity_frame(graph: Graph) -> DataFrame:
    """One row: triangles, triples, transitivity (0 without triples)."""
    t = triangle_list(graph).agg(F.count("*").alias("triangles"))
    e = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    d = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    p = d.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).cast("long").alias("triples"))
    return t.join(p).select("triangles", "triples", F.when(F.col("triples") > 0, 3.0 * F.col("triangles") / F.when(F.col("triples") > 0, F.col("triples"))).otherwise(0.0).alias("transitivity"))


def transitivity(graph: Graph) -> float:
    return transitivity_frame(graph).first()["transitivity"]


def assortativity_frame(graph: Graph) -> DataFrame:
    """One row: Pearson correlation of the degrees at both ends of the edges, each edge both ways; 0 without variance."""
    d = graph.degrees()
    e = graph.edges.select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    r = both.join(d.toDF("src", "j"), "src").join(d.toDF("dst", "k"), "dst").select(F.col("j").cast("double").alias("j"), F.col("k").cast("double").alias("k"))
    s = r.agg(F.count("*").alias("n"), F.sum("j").alias("j"), F.sum(F.col("j") * F.col("k")).alias("jk"), F.sum(F.col("j") * F.col("j")).alias("jj"))
    var = F.col("n") * F.col("jj") - F.col("j") * F.col("j")
    return s.select(F.when(var > 0, (F.col("n") * F.col("jk") - F.col("j") * F.col("j")) / F.when(var > 0, var)).otherwise(0.0).alias("assortativity"))


def assortativity(graph: Graph) -> float:
    return assortativity_frame(graph).first()[0]


def eccentricities(graph: Graph, plan: str = "auto") -> DataFrame:
    """(id, reached, eccentricity, total): vertices reached, most hops, and sum of hops."""
    return hops(graph, plan=plan).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reached"), F.max("depth").alias("eccentricity"), F.sum("depth").alias("total"))


def distance_frame(graph: Graph) -> DataFrame:
    """One row: diameter, radius, average_path_length; null for an empty graph or where some pair has no path."""
    n = graph.vertices.agg(F.count("*").alias("n"))
    e = eccentricities(graph).agg(F.min("reached").alias("least"), F.max("eccentricity").alias("d"), F.min("eccentricity").alias("r"), F.sum("total").alias("t"))
    whole = (F.col("n") > 0) & (F.col("least") == F.col("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    apl = F.when(F.col("n") == 1, 0.0).otherwise(F.col("t") / F.when(pairs > 0, pairs))
    return n.join(e).select(*[F.when(whole, c).alias(a) for c, a in ((F.col("d"), "diameter"), (F.col("r"), "radius"), (apl, "average_path_length"))])


def diameter(graph: Graph) -> int | None:
    return distance_frame(graph).first()["diameter"]


def radius(graph: Graph) -> int | None:
    return distance_frame(graph).first()["radius"]


def average_path_length(graph: Graph) -> float | None:
    return distance_frame(graph).first()["average_path_length"]
