"""Link prediction: scores of node pairs from shared neighbours.

``pairs`` is a table (u, v), in any order, by default every unordered pair of nodes.
Scores other than 0 need a path of two edges, so those are joined and the rest is
filled in; with ``nonzero=True`` and no ``pairs`` the all-pairs table is never formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Expr, Graph, column


def all_pairs(graph: Graph) -> DataFrame:
    """(u, v) with u < v: quadratic in the vertices by definition."""
    ids = graph.vertices.select(F.col("id").alias("u"))
    return ids.join(graph.vertices.select(F.col("id").alias("v")), F.col("u") < F.col("v"))


def _degrees(graph: Graph) -> DataFrame:
    """(id, deg): neighbours as a list, so parallel edges count."""
    return graph.arcs("out").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def _set_sizes(graph: Graph) -> DataFrame:
    return graph.neighbour_pairs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def _two_paths(graph: Graph, pairs: DataFrame | None) -> DataFrame:
    """(u, v, w) for each distinct common neighbour w of a pair."""
    n = graph.neighbour_pairs()
    a = n.select(F.col("src").alias("u"), F.col("dst").alias("w"))
    b = n.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    if pairs is None:
        return a.join(b, "w").filter("u < v")
    return pairs.select("u", "v").distinct().join(a, "u").join(b, ["v", "w"]).select("u", "v", "w")


#: Most vertices whose ids every task holds to write out all pairs, and pairs a task writes.
HELD, PAIRS = 4_000_000, 1_000_000


def _filled(graph: Graph, scores: DataFrame, default: Column) -> DataFrame:
    """(u, v, score) of all pairs u < v: each u comes once, with its scores, and is paired with all ids above it in its task, so no pair is shuffled."""
    ids = np.sort(graph.vertices.select("id").filter("id is not null").toArrow()["id"].to_numpy())
    shared = graph.spark.sparkContext.broadcast(ids)
    kind, fill = dict(scores.dtypes)["score"], graph.spark.range(1).select(default.alias("x")).first()[0]
    u_kind = dict(graph.vertices.dtypes)["id"]
    own = scores.groupBy("u").agg(F.collect_list(F.struct("v", "score")).alias("near"))
    rows = graph.vertices.select(F.col("id").alias("u")).filter("u is not null").join(own, "u", "left").select("u", "near.v", "near.score")
    tasks = max(1, min(100_000, len(ids), len(ids) ** 2 // 2 // PAIRS))

    def run(batches):
        ids = shared.value
        for batch in batches:
            for u, near, score in zip(batch.column("u").to_pylist(), batch.column("v"), batch.column("score")):
                above = ids[np.searchsorted(ids, u, "right") :]
                if not len(above):
                    continue
                out = np.full(len(above), fill, np.float64 if kind == "double" else np.int64)
                if near.is_valid:
                    near, score = near.values.to_numpy(), score.values.to_numpy()
                    at, end = np.searchsorted(above, near), np.searchsorted(above, near, "right")
                    while (at < end).any():
                        some = at < end
                        out[at[some]] = score[some]
                        at = at + 1
                for i in range(0, len(above), 1 << 20):
                    part = above[i : i + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), u, ids.dtype)), pa.array(part), pa.array(out[i : i + (1 << 20)])], names=["u", "v", "score"])

    return rows.repartition(tasks, "u").mapInArrow(run, f"u {u_kind}, v {u_kind}, score {kind}")


def _scored(graph: Graph, pairs: DataFrame | None, scores: DataFrame, nonzero: bool, default: Column) -> DataFrame:
    if pairs is None and nonzero:
        return scores.select("u", "v", "score")
    if pairs is None and dict(graph.vertices.dtypes)["id"] == "bigint" and dict(scores.dtypes)["score"] in ("double", "bigint") and graph.vertices.limit(HELD + 1).count() <= HELD:
        return _filled(graph, scores.select("u", "v", "score"), default)
    base = all_pairs(graph) if pairs is None else pairs
    return base.join(scores, ["u", "v"], "left").withColumn("score", F.coalesce("score", default))


def jaccard_coefficient(graph: Graph, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """|common| / |union| of neighbour sets; 0 where the union is empty."""
    common = _two_paths(graph, pairs).groupBy("u", "v").agg(F.count("*").alias("c"))
    d = _set_sizes(graph)
    s = common.join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    return _scored(graph, pairs, s.select("u", "v", (F.col("c") / (F.col("du") + F.col("dv") - F.col("c"))).alias("score")), nonzero, F.lit(0.0))


def _weighted(graph: Graph, pairs: DataFrame | None, weight: Column, keep: str, nonzero: bool) -> DataFrame:
    two = _two_paths(graph, pairs).join(_degrees(graph).toDF("w", "deg"), "w").filter(keep)
    return _scored(graph, pairs, two.groupBy("u", "v").agg(F.sum(weight).alias("score")), nonzero, F.lit(0.0))


def adamic_adar_index(graph: Graph, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """Sum of 1 / ln(deg) over common neighbours of degree above 1."""
    return _weighted(graph, pairs, 1.0 / F.log(F.col("deg").cast("double")), "deg > 1", nonzero)


def resource_allocation_index(graph: Graph, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """Sum of 1 / deg over common neighbours."""
    return _weighted(graph, pairs, 1.0 / F.col("deg"), "deg > 0", nonzero)


def common_neighbors(graph: Graph, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """Number of common neighbours, as a whole number."""
    c = _two_paths(graph, pairs).groupBy("u", "v").agg(F.count("*").alias("score"))
    return _scored(graph, pairs, c, nonzero, F.lit(0).cast("long"))


def common_neighbors_of(graph: Graph, u: int, v: int) -> int:
    """Number of common neighbours of one pair."""
    return common_neighbors(graph, graph.spark.createDataFrame([(u, v)], "u long, v long")).first()["score"]


def preferential_attachment(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """deg(u) * deg(v)."""
    d = graph.vertices.select("id").join(_degrees(graph), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    base = all_pairs(graph) if pairs is None else pairs
    s = base.join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    return s.select("u", "v", (F.col("du") * F.col("dv")).cast("double").alias("score"))


def common_neighbor_centrality(graph: Graph, pairs: DataFrame | None = None, alpha: float = 0.8) -> DataFrame:
    """Number of common neighbours to the power alpha (0 ** 0 = 1)."""
    return common_neighbors(graph, pairs).withColumn("score", F.pow(F.col("score").cast("double"), F.lit(float(alpha))))


def _labels(graph: Graph, community: Expr | DataFrame) -> DataFrame:
    """(id, c) from a column over the vertex columns or a table (id, component)."""
    if isinstance(community, DataFrame):
        return community.select(community.columns[0], community.columns[1]).toDF("id", "c")
    return graph.vertices.select("id", column(community).alias("c"))


def _labelled(graph: Graph, pairs: DataFrame | None, community: Expr | DataFrame) -> DataFrame:
    c = _labels(graph, community)
    two = _two_paths(graph, pairs)
    return two.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").join(c.toDF("w", "cw"), "w").withColumn("inside", (F.col("cu") == F.col("cv")) & (F.col("cu") == F.col("cw")))


def cn_soundarajan_hopcroft(graph: Graph, community: Expr | DataFrame, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """Common neighbours in the community that both nodes share."""
    s = _labelled(graph, pairs, community).filter("inside").groupBy("u", "v").agg(F.count("*").cast("double").alias("score"))
    return _scored(graph, pairs, s, nonzero, F.lit(0.0))


def ra_index_soundarajan_hopcroft(graph: Graph, community: Expr | DataFrame, pairs: DataFrame | None = None, nonzero: bool = False) -> DataFrame:
    """Sum of 1 / deg over common neighbours in the shared community."""
    s = _labelled(graph, pairs, community).filter("inside").join(_degrees(graph).toDF("w", "deg"), "w").groupBy("u", "v").agg(F.sum(1.0 / F.col("deg")).alias("score"))
    return _scored(graph, pairs, s, nonzero, F.lit(0.0))


def within_inter_cluster(graph: Graph, community: Expr | DataFrame, delta: float = 0.001, pairs: DataFrame | None = None) -> DataFrame:
    """(within + delta) / (inter + delta) over common neighbours; with delta 0, 0 / 0 is NaN and x / 0 infinite."""
    w = F.sum(F.when(F.col("inside"), 1).otherwise(0))
    s = _labelled(graph, pairs, community).groupBy("u", "v").agg(w.alias("within"), (F.count("*") - w).alias("inter"))
    base = all_pairs(graph) if pairs is None else pairs
    d = F.lit(float(delta))
    num, den = F.coalesce("within", F.lit(0)) + d, F.coalesce("inter", F.lit(0)) + d
    score = F.when(den != 0, num / F.when(den != 0, den)).when(num == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return base.join(s, ["u", "v"], "left").withColumn("score", score).drop("within", "inter")
