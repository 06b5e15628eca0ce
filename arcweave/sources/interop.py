"""pandas tables and networkx-like objects. All of these hold the graph on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def to_node_dataframe(graph: Graph):
    """pandas (node_id, attr)."""
    return graph.vertices.select(F.col("id").alias("node_id"), "attr").orderBy("node_id").toPandas()


def to_edge_dataframe(graph: Graph):
    """pandas (source, target, weight): one row a stored edge."""
    return graph.edges.orderBy("eid").select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight").toPandas()


def from_pandas(spark: SparkSession, nodes, edges, directed: bool = False) -> Graph:
    """From the two tables above."""
    n = [(int(a), b) for a, b in zip(nodes["node_id"], nodes["attr"])]
    e = [(int(a), int(b), float(w)) for a, b, w in zip(edges["source"], edges["target"], edges["weight"])]
    return Graph.from_lists(spark, n, e, directed)


def to_networkx(graph: Graph, create=None):
    """A networkx graph, or whatever ``create(directed)`` gives that has add_node and add_edge."""
    if create is None:
        import networkx

        create = lambda directed: (networkx.DiGraph if directed else networkx.Graph)()
    out = create(graph.directed)
    for r in to_node_dataframe(graph).itertuples():
        out.add_node(r.node_id, attr=r.attr)
    for r in to_edge_dataframe(graph).itertuples():
        out.add_edge(r.source, r.target, weight=r.weight)
    return out


def from_networkx(spark: SparkSession, nx) -> Graph:
    """From anything with is_directed, nodes(data=True) and edges(data=True).

    Whole-number nodes keep their ids, others get free ones; attr is 0 and weight 1
    where missing.
    """
    nodes = list(nx.nodes(data=True))
    ids = {n: n for n, _ in nodes if isinstance(n, int) and not isinstance(n, bool)}
    used, nxt = set(ids.values()), 0
    for n, _ in nodes:
        if n not in ids:
            while nxt in used:
                nxt += 1
            ids[n] = nxt
            used.add(nxt)
    v = [(ids[n], d.get("attr", 0)) for n, d in nodes]
    e = [(ids[a], ids[b], float(d.get("weight", 1.0))) for a, b, d in nx.edges(data=True)]
    return Graph.from_lists(spark, v, e, nx.is_directed())
