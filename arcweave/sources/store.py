"""Whole graphs in files: JSON documents, Parquet folders, GraphML export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphIOError, InvalidGraph, SerializationError
from ..graph import Graph
from ..plans.tables import indexed

#: A JSON document is one value; graphs above this many vertices and edges belong in Parquet.
JSON_LIMIT = 5_000_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def to_serializable(graph: Graph) -> dict:
    """{directed, nodes: [attr], edges: [[source position, target position, weight]]}, vertices by id."""
    if graph.size_upto(JSON_LIMIT) > JSON_LIMIT:
        raise SerializationError(f"more than {JSON_LIMIT} vertices and edges: save it as Parquet")
    v = graph.vertices.select("id", "attr").orderBy("id").collect()
    at = {r["id"]: i for i, r in enumerate(v)}
    e = graph.edges.select("src", "dst", "weight").orderBy("eid").collect()
    return {"directed": graph.directed, "nodes": [r["attr"] for r in v], "edges": [[at[r["src"]], at[r["dst"]], r["weight"]] for r in e]}


def from_serializable(spark: SparkSession, data: dict, directed: bool | None = None) -> Graph:
    """Lenient: ``directed`` (by default what the data says) decides."""
    try:
        nodes, edges = data["nodes"], data["edges"]
        kind = data["directed"] if directed is None else directed
        if any(not 0 <= x < len(nodes) for e in edges for x in e[:2]):
            raise SerializationError("an edge names a node that isn't there")
        return Graph.from_lists(spark, list(enumerate(nodes)), [tuple(e) for e in edges], kind)
    except (KeyError, TypeError) as e:
        raise SerializationError(str(e)) from e


def try_from_serializable(spark: SparkSession, data: dict, directed: bool) -> Graph:
    """Raises if the data's direction is another."""
    if bool(data.get("directed")) != directed:
        raise InvalidGraph("the stored graph has another direction")
    return from_serializable(spark, data, directed)


def save_json(graph: Graph, path: str) -> None:
    _write_text(graph.spark, path, json.dumps(to_serializable(graph), indent=2))


def _read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        raise GraphIOError(f"nothing at {path}")
    try:
        return json.loads(rows[0][0])
    except ValueError as e:
        raise SerializationError(str(e)) from e


def load_json(spark: SparkSession, path: str, directed: bool | None = None) -> Graph:
    return from_serializable(spark, _read_json(spark, path), directed)


def load_json_strict(spark: SparkSession, path: str, directed: bool) -> Graph:
    return try_from_serializable(spark, _read_json(spark, path), directed)


def save_binary(graph: Graph, path: str) -> None:
    """A folder with ``vertices`` and ``edges`` in Parquet and the direction in ``meta``; any size."""
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.spark.createDataFrame([(graph.directed,)], "directed boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_binary(spark: SparkSession, path: str, directed: bool | None = None) -> Graph:
    stored = spark.read.parquet(f"{path}/meta").first()["directed"]
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), stored if directed is None else directed)


def load_binary_strict(spark: SparkSession, path: str, directed: bool) -> Graph:
    if spark.read.parquet(f"{path}/meta").first()["directed"] != directed:
        raise InvalidGraph("the stored graph has another direction")
    return load_binary(spark, path, directed)


def graphml_lines(graph: Graph) -> DataFrame:
    """(ord, value): lines of a GraphML document, attributes escaped."""
    spark = graph.spark

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    kind = "directed" if graph.directed else "undirected"
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        '  <key id="d0" for="node" attr.name="value" attr.type="string"/>',
        '  <key id="d1" for="edge" attr.name="weight" attr.type="double"/>',
        f'  <graph id="G" edgedefault="{kind}">',
    ]
    ids = indexed(graph.vertices.select("id"), ["id"], "k")
    v = graph.vertices.join(ids, "id").select(F.struct(F.lit(1).alias("part"), F.col("k").alias("k")).alias("ord"), F.format_string('    <node id="n%d"><data key="d0">%s</data></node>', F.col("k"), F.coalesce(esc(F.col("attr").cast("string")), F.lit(""))).alias("value"))
    e = graph.edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst")
    e = e.select(F.struct(F.lit(2).alias("part"), F.col("eid").alias("k")).alias("ord"), F.concat(F.format_string('    <edge source="n%d" target="n%d"><data key="d1">', F.col("s"), F.col("d")), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "  </graph>"), (3, 1, "</graphml>")], "part int, k long, value string")
    return frame.select(F.struct("part", "k").alias("ord"), "value").unionByName(v).unionByName(e)


def save_graphml(graph: Graph, path: str) -> None:
    """One ordered text file (a folder with one part)."""
    graphml_lines(graph).orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(path)
