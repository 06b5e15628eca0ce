"""Text, JSON, Parquet, GraphML, interop and the edge stream."""

import pytest

from arcweave.errors import InvalidGraph, SerializationError
from arcweave.graph import Graph
from arcweave.sources import interop, store, text
from arcweave.streaming import edges as stream


@pytest.fixture(scope="module")
def g(spark):
    return Graph.from_lists(spark, [(1, 10), (2, 20), (5, 50)], [(1, 2, 1.5), (2, 5, 2.0)], True)


def pairs(graph):
    return sorted((r["src"], r["dst"], r["weight"]) for r in graph.edges.collect())


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n1,2,3.5\n\n2,3 # note\nlonely\n 4 , 4 , 1 \n")
    assert pairs(text.read_edge_list(spark, str(tmp_path / "e.txt"), ",")) == [(1, 2, 3.5), (2, 3, 1.0), (4, 4, 1.0)]
    (tmp_path / "bad.txt").write_text("1,x\n")
    with pytest.raises(SerializationError):
        text.read_edge_list(spark, str(tmp_path / "bad.txt"), ",")


def test_adjacency_list(spark, tmp_path, g):
    (tmp_path / "a.txt").write_text("1 2 0.5 3 1.5\n2 3\n7\n")
    h = text.read_adjacency_list(spark, str(tmp_path / "a.txt"))
    assert pairs(h) == [(1, 2, 0.5), (1, 3, 1.5), (2, 3, 1.0)] and h.contains_node(7)
    text.write_adjacency_list(g.map_node_attrs("id"), str(tmp_path / "w"))
    assert pairs(text.read_adjacency_list(spark, str(tmp_path / "w"), directed=True)) == pairs(g)


def test_loose(spark, tmp_path):
    (tmp_path / "l.txt").write_text("from to\n1 2\n2,1\n3\t3\n2 3\n")
    assert pairs(text.read_loose_edges(spark, str(tmp_path / "l.txt"))) == [(1, 2, 1.0), (2, 3, 1.0)]


def test_json_and_parquet(spark, tmp_path, g):
    at = str(tmp_path / "g.json")
    store.save_json(g, at)
    assert pairs(store.load_json(spark, at)) == [(0, 1, 1.5), (1, 2, 2.0)]
    with pytest.raises(InvalidGraph):
        store.load_json_strict(spark, at, False)
    store.save_binary(g, str(tmp_path / "b"))
    assert pairs(store.load_binary(spark, str(tmp_path / "b"))) == pairs(g)
    with pytest.raises(SerializationError):
        store.from_serializable(spark, {"nodes": [1], "edges": [[0, 4, 1.0]], "directed": False})


def test_graphml(spark, tmp_path, g):
    import xml.etree.ElementTree as et

    odd = Graph(g.vertices.selectExpr("id", "'<&>' as attr"), g.edges, True)
    store.save_graphml(odd, str(tmp_path / "x"))
    body = "\n".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    root = et.fromstring(body.encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == 3 and root.find(f".//{ns}data").text == "<&>"


def test_interop(spark, g):
    n, e = interop.to_node_dataframe(g), interop.to_edge_dataframe(g)
    assert list(n.columns) == ["node_id", "attr"] and pairs(interop.from_pandas(spark, n, e, True)) == pairs(g)

    class Nx:
        def __init__(self, directed=True):
            self.n, self.e, self.k = {}, [], directed

        def is_directed(self):
            return self.k

        def add_node(self, i, **k):
            self.n[i] = k

        def add_edge(self, a, b, **k):
            self.e.append((a, b, k))

        def nodes(self, data):
            return list(self.n.items())

        def edges(self, data):
            return self.e

    nx = interop.to_networkx(g, Nx)
    assert pairs(interop.from_networkx(spark, nx)) == pairs(g)
    nx.add_node("x")
    assert interop.from_networkx(spark, nx).node_count() == 4


def test_stream(spark, tmp_path, g):
    g.edges.repartition(2).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(g.edges.schema).parquet(str(tmp_path / "in"))
    stream.ingest(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert pairs(stream.stored_graph(spark, str(tmp_path / "out"), True)) == pairs(g)
    q = stream.degree_stream(spark.readStream.schema(g.edges.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["degree"] for r in spark.table("deg").collect()} == {1: 1, 2: 2, 5: 1}
