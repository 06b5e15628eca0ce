"""Edge lists and adjacency lists as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SerializationError
from ..graph import Graph
from ..plans.tables import indexed

_INT = r"^[+-]?\d+$"


def _tokens(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(line, tok): lines without comments and blanks, cut at one character, tokens trimmed."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line <> ''")
    quoted = "\\Q" + sep[:1] + "\\E"
    return lines.select("line", F.transform(F.split("line", quoted, -1), lambda t: F.trim(t)).alias("tok"))


def _reject(rows: DataFrame, bad: Column) -> None:
    row = rows.filter(bad).select("line").first()
    if row is not None:
        raise SerializationError(f"can't be read: {row['line']!r}")


def read_edge_list(spark: SparkSession, path: str, sep: str = " ", directed: bool = False) -> Graph:
    """``source sep target [sep weight]`` a line; ``#`` starts a comment; lines of one token are skipped; weight 1 by default.

    Vertex ids are the numbers in the file.  A bad number raises.
    """
    rows = _tokens(spark, path, sep).filter(F.size("tok") >= 2)
    w = F.when(F.size("tok") > 2, F.expr("try_cast(get(tok, 2) as double)")).otherwise(F.lit(1.0))
    rows = rows.select("line", F.expr("try_cast(get(tok, 0) as bigint)").alias("src"), F.expr("try_cast(get(tok, 1) as bigint)").alias("dst"), w.alias("weight"))
    _reject(rows, F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull())
    return Graph.from_edges(rows.select("src", "dst", "weight"), directed, weight="weight")


def load_edge_list(spark: SparkSession, path: str, sep: str = " ", directed: bool = False) -> tuple[Graph, tuple[int, int]]:
    """(graph, (vertices, edges)) of an edge list; ids are packed as 0 to n - 1 in ascending order of the file's, which become the attributes."""
    graph = read_edge_list(spark, path, sep, directed)
    graph = graph.relabel()
    return graph, (graph.node_count(), graph.edge_count())


def write_edge_list(graph: Graph, path: str, sep: str = " ") -> None:
    """``source attr sep target attr sep weight`` a line; isolated vertices are lost."""
    a = graph.vertices.select("id", F.col("attr").cast("string").alias("a"))
    e = graph.edges.join(a.toDF("src", "s"), "src").join(a.toDF("dst", "d"), "dst")
    e.select(F.concat_ws(sep, "s", "d", F.col("weight").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_adjacency_list(spark: SparkSession, path: str, sep: str = " ", directed: bool = False) -> Graph:
    """``node [sep neighbour sep weight]...`` a line; a last neighbour without weight gets 1; ``neighbour:weight`` is read too."""
    rows = _tokens(spark, path, sep).withColumn("at", F.monotonically_increasing_id())
    colon = F.exists("tok", lambda t: F.contains(t, F.lit(":")))
    pair = F.transform(F.filter(F.slice("tok", 2, F.greatest(F.lit(1), F.size("tok"))), lambda t: t != ""), lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).alias("n"), F.when(F.contains(t, F.lit(":")), F.split_part(t, F.lit(":"), F.lit(2))).otherwise(F.lit("1.0")).alias("w")))
    flat = F.transform(F.when(F.size("tok") > 1, F.sequence(F.lit(1), F.size("tok") - 1, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("tok", i).alias("n"), F.coalesce(F.get("tok", i + 1), F.lit("1.0")).alias("w")))
    near = rows.select("line", F.get("tok", F.lit(0)).alias("s"), F.explode_outer(F.when(colon, pair).otherwise(flat)).alias("p"))
    near = near.select("line", F.expr("try_cast(s as bigint)").alias("src"), F.col("p.n").alias("n"), F.expr("try_cast(p.n as bigint)").alias("dst"), F.expr("try_cast(p.w as double)").alias("weight"))
    _reject(near, F.col("src").isNull() | F.col("n").isNotNull() & (F.col("dst").isNull() | F.col("weight").isNull()))
    e = near.filter("dst is not null").select("src", "dst", "weight")
    v = near.select(F.explode(F.array("src", "dst")).alias("id")).filter("id is not null").distinct().withColumn("attr", F.col("id"))
    return Graph.from_edges(e, directed, weight="weight", vertices=v)


def write_adjacency_list(graph: Graph, path: str, sep: str = " ") -> None:
    """``node sep neighbour:weight ...`` a line, each edge under its stored source; all vertices have a line."""
    a = graph.vertices.select("id", F.col("attr").cast("string").alias("a"))
    near = graph.edges.join(a.toDF("dst", "d"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("eid", F.concat("d", F.lit(":"), F.col("weight").cast("string")).alias("t")))).alias("x"))
    rows = a.join(near, "id", "left").select(F.concat_ws(sep, "a", F.array_join(F.transform("x", lambda s: s["t"]), sep)).alias("value"))
    rows.write.mode("overwrite").text(path)


def read_loose_edges(spark: SparkSession, path: str) -> Graph:
    """Undirected simple graph from lines parted by commas or white space; lines that aren't two numbers, self-loops and repeats are dropped."""
    t = F.split(F.trim("value"), r"[,\s]+")
    rows = spark.read.text(path).select(t.alias("t")).filter(F.size("t") >= 2)
    rows = rows.select(F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b")).filter(F.col("a").rlike(_INT) & F.col("b").rlike(_INT))
    e = rows.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return Graph.from_edges(indexed(e, ["src", "dst"], "eid"))
