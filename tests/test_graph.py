"""Core graph, conventions for loops and parallel edges, changes and matrices."""

import pytest

from arcweave.errors import EdgeNotFound, InvalidArgument, NodeNotFound
from arcweave.graph import Graph
from arcweave.operators import builders, subgraphs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """A self-loop and two parallel edges."""
    return Graph.from_lists(spark, [0, 1], [(0, 0), (0, 1), (0, 1)])


def test_degree_conventions(odd):
    from arcweave.operators.centrality import degree_centrality

    assert rows(odd.degrees()) == [(0, 3), (1, 2)]
    assert rows(degree_centrality(odd)) == [(0, 4.0), (1, 2.0)]


def test_arc_views(odd):
    assert odd.arcs("out").count() == 5
    assert odd.arcs("flow").count() == 6


def test_lookups(odd):
    assert odd.contains_node(1) and not odd.contains_node(9)
    assert odd.contains_edge(1, 0) and odd.find_edge(1, 0) == 1
    assert odd.get_edge_weight(0, 1) == 1.0
    assert len(odd) == 2 and 1 in odd and list(odd) == [0, 1]
    with pytest.raises(NodeNotFound):
        odd[7]


def test_changes(spark):
    g = Graph.from_lists(spark, [0, 1, 2], [(0, 1, 2.0), (1, 2, 3.0)])
    g, new = g.add_node(5)
    assert new == 3
    g = g.add_edges([(2, 3, 1.5)])
    assert g.edge_count() == 3
    with pytest.raises(NodeNotFound):
        g.add_edges([(0, 99)])
    with pytest.raises(InvalidArgument):
        g.add_edges([(0, 1, float("nan"))])
    h = g.remove_node(1)
    assert rows(h.edges.select("src", "dst")) == [(2, 3)] and rows(h.vertices.select("id")) == [(0,), (2,), (3,)]
    assert g.remove_edge_between(1, 0).edge_count() == 2
    with pytest.raises(EdgeNotFound):
        g.remove_edge(77)
    assert g.update_edge_weight(0, 1, 9.0).get_edge_weight(0, 1) == 9.0
    assert not g.add_edge_if_absent(1, 0)[2]
    assert g.clear().is_empty()


def test_density(spark):
    assert Graph.empty(spark).density() == 0.0
    assert Graph.from_lists(spark, [0, 1], [(0, 1)]).density() == 1.0


def test_matrices(spark):
    g = Graph.from_lists(spark, [0, 1, 2], [(0, 1, 2.0), (0, 1, 5.0), (1, 2, 1.0)])
    assert rows(g.adjacency_matrix()) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 1.0), (2, 1, 1.0)]
    assert rows(g.sparse_adjacency_matrix())[0] == (0, 1, 7.0)
    assert rows(Graph.from_matrix(g.adjacency_matrix()).edges) == [(0, 0, 1, 5.0), (1, 1, 2, 1.0)]


def test_builder_checks(spark):
    b = builders.GraphBuilder().add_nodes([1, 2]).add_edge(0, 1).add_edge(1, 0)
    assert b.build(spark).edge_count() == 2
    with pytest.raises(InvalidArgument):
        b.allow_parallel_edges(False).build(spark)
    with pytest.raises(InvalidArgument):
        builders.GraphBuilder().add_node(1).add_edge(0, 4).build(spark)
    with pytest.raises(InvalidArgument):
        builders.GraphBuilder().add_node(1).allow_self_loops(False).add_edge(0, 0).build(spark)


def test_topologies(spark):
    t = builders.TopologyBuilder
    assert t.cycle(spark, 1).edge_count() == 1 and t.cycle(spark, 2).edge_count() == 2
    assert t.grid(spark, 2, 3).edge_count() == 7 and t.complete(spark, 0).is_empty()
    assert t.star(spark, 5).edge_count() == 4 and t.path(spark, 1).edge_count() == 0


def test_subgraphs(spark):
    g = Graph.from_lists(spark, range(5), [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert rows(subgraphs.ego_graph(g, 2, 1).vertices.select("id")) == [(1,), (2,), (3,)]
    assert subgraphs.component_subgraph(g, 99).is_empty()
    with pytest.raises(NodeNotFound):
        subgraphs.subgraph(g, [0, 42])
    assert rows(subgraphs.filter_nodes(g, "attr >= 3").edges.select("src", "dst")) == [(3, 4)]
