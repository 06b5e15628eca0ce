"""Edges that arrive as a stream: running degrees, and a stored graph that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def degree_stream(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Running (id, degree) of a streaming (src, dst); write it in update or complete mode."""
    ends = F.array("src", "dst") if directed else F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def windowed_edges(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, src, dst, weight): arcs per time window; what is later than ``late`` is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "src", "dst").agg(F.count("*").cast("double").alias("weight"))


def ingest(edges: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Appends a streaming (src, dst, weight) to an edge folder, once per batch; returns the started query.

    A batch is written into a folder of its own number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, k: int) -> None:
        rows = batch.select((F.lit(k).cast("long") * F.lit(1 << 33) + F.monotonically_increasing_id()).alias("eid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={k}")
        if on_batch:
            on_batch(rows, k)

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_graph(spark, path: str, directed: bool = False) -> Graph:
    """The graph of an edge folder as it is now."""
    return Graph.from_edges(spark.read.parquet(path).drop("batch"), directed, weight="weight")
