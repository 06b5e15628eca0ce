"""Hand-computed answers, plans against each other, and validity of heuristics."""

import itertools
import random

import pytest

from arcweave.errors import HasCycle, InvalidArgument, InvalidGraph, NodeNotFound, NoPath
from arcweave.graph import Graph
from arcweave.operators import approximation as ap
from arcweave.operators import centrality as ce
from arcweave.operators import community as cm
from arcweave.operators import components as co
from arcweave.operators import generators as ge
from arcweave.operators import metrics as me
from arcweave.operators import mst as ms
from arcweave.operators import paths as pa
from arcweave.operators import traversal as tr
from arcweave.operators import validation as va


def d(df):
    return {r[0]: r[1] for r in df.collect()}


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def random_graph(spark, seed, n=14, m=30, directed=False):
    r = random.Random(seed)
    pairs = [p for p in itertools.product(range(n), range(n)) if (p[0] < p[1] or directed and p[0] != p[1])]
    return Graph.from_lists(spark, range(n), [(a, b, float(r.randint(1, 9))) for a, b in r.sample(pairs, m)], directed)


@pytest.fixture(scope="module")
def bridge(spark):
    """Two complete graphs of four, joined by one edge."""
    k4 = list(itertools.combinations(range(4), 2))
    return Graph.from_lists(spark, range(8), k4 + [(a + 4, b + 4) for a, b in k4] + [(3, 4)])


def test_small_metrics(spark):
    p3 = Graph.from_lists(spark, range(3), [(0, 1), (1, 2)])
    assert me.diameter(p3) == 2 and me.radius(p3) == 1 and me.transitivity(p3) == 0
    assert d(ce.betweenness_centrality(p3)) == {0: 0.0, 1: 1.0, 2: 0.0}
    k4 = Graph.from_lists(spark, range(4), [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)])
    assert me.transitivity(k4) == 6 / 8 and d(me.triangles(k4)) == {0: 2, 1: 2, 2: 1, 3: 1}
    star = ge.star_graph(spark, 5)
    assert me.assortativity(star) == -1.0 and ids(ap.min_weighted_vertex_cover(star)) == {0}
    assert [r["id"] for r in ce.voterank(star, 1).collect()] == [0]
    empty = Graph.empty(spark)
    assert me.diameter(empty) is None and not va.is_connected(empty) and va.is_bipartite(empty)
    one = Graph.from_lists(spark, [4], [])
    assert me.average_path_length(one) == 0.0


def test_cycle(spark):
    c6 = ge.cycle_graph(spark, 6)
    assert va.is_bipartite(c6) and me.diameter(c6) == 3 and ap.treewidth_min_degree(c6)[0] == 2 and ap.treewidth_min_fill_in(c6)[0] == 2
    assert not va.is_bipartite(ge.cycle_graph(spark, 5))


def test_bridge(bridge):
    parts = d(cm.girvan_newman(bridge, 2))
    assert parts == {i: 0 if i < 4 else 4 for i in range(8)}
    assert d(cm.louvain(bridge)) == parts
    top = ce.edge_betweenness_centrality(bridge).orderBy("betweenness", ascending=False).first()
    assert {top["u"], top["v"]} == {3, 4} and top["betweenness"] == 16.0
    assert cm.modularity(bridge, cm.louvain(bridge)).first()[0] > 0.4
    assert ap.large_clique_size(bridge) == 4 and len({r["clique"] for r in ap.clique_removal(bridge).collect()}) == 2


def test_negative_weights(spark):
    g = Graph.from_lists(spark, range(3), [(0, 1, 4.0), (0, 2, 5.0), (2, 1, -3.0)], True)
    assert d(pa.bellman_ford(g, 0)) == {0: 0.0, 1: 2.0, 2: 5.0}
    with pytest.raises(InvalidArgument):
        pa.dijkstra(g, 0)
    assert {(r["src"], r["id"]): r["dist"] for r in pa.johnson(g).collect()}[0, 1] == 2.0
    bad = Graph.from_lists(spark, range(2), [(0, 1, 1.0), (1, 0, -2.0)], True)
    assert pa.bellman_ford(bad, 0) is None and pa.johnson(bad) is None


def test_dijkstra_forms(spark):
    g = random_graph(spark, 3)
    a, b = d(pa.dijkstra(g, 0)), d(pa.dijkstra(g, 0, plan="distributed"))
    assert a == b == d(pa.bellman_ford(g, 0))
    cost, path = pa.shortest_path(g, 0, 9)
    assert cost == a[9] and path[0] == 0 and path[-1] == 9
    assert pa.a_star(g, 0, 9, "0.0")[0] == cost
    blocked = d(pa.dijkstra(g, 0, cost="case when weight < 3 then weight end"))
    assert all(v is None or v >= a[k] for k, v in blocked.items())
    with pytest.raises(NodeNotFound):
        pa.dijkstra(g, 99)


def test_traversal(spark):
    g = Graph.from_lists(spark, range(6), [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    assert [r["id"] for r in tr.bfs(g, 0).collect()] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in tr.dfs(g, 0).orderBy("pos").collect()] == [0, 1, 3, 2, 4]
    assert tr.iddfs(g, 0, 4, 2) is None and tr.iddfs(g, 0, 4, 3) == [0, 1, 3, 4]
    assert tr.bidis(g, 2, 2) == [2] and tr.bfs(g, 77).isEmpty()
    with pytest.raises(NoPath):
        tr.try_bidirectional_search(g, 0, 5)


@pytest.mark.parametrize("seed", [1])
def test_plans_agree(spark, seed):
    g, h = random_graph(spark, seed), random_graph(spark, seed, directed=True)
    same = lambda f, x, digits=7: {k: round(v, digits) for k, v in d(f(x, plan="local")).items()} == {k: round(v, digits) for k, v in d(f(x, plan="distributed")).items()}
    assert same(co.connected_components, g) and same(co.strongly_connected_components, h)
    assert same(lambda x, plan: ce.pagerank(x, max_iter=3, tol=0.0, plan=plan), h)
    assert same(lambda x, plan: ce.katz_centrality(x, 0.001, tol=1e-3, plan=plan), g)
    assert same(lambda x, plan: ce.betweenness_centrality(x, True, plan=plan), g)
    assert same(lambda x, plan: ce.eigenvector_centrality(x, tol=0.05, plan=plan), g, 4)
    assert ids(ap.maximum_independent_set(g, "local")) == ids(ap.maximum_independent_set(g, "distributed"))
    assert d(ap.min_maximal_matching(g, "local")) == d(ap.min_maximal_matching(g, "distributed"))
    assert d(ms.boruvka_mst(g, "local")).keys() == d(ms.boruvka_mst(g, "distributed")).keys()
    hop = lambda p: {tuple(r) for r in pa.all_pairs_shortest_path_length(g, p).select("src", "id", "depth").collect()}
    assert hop("local") == hop("distributed")


def test_heuristics_are_valid(spark):
    for seed in (5, 6):
        g = random_graph(spark, seed)
        e = [(r["src"], r["dst"]) for r in g.edges.collect()]
        pairs = {frozenset(x) for x in e}
        cover, free, clique = ids(ap.min_weighted_vertex_cover(g)), ids(ap.maximum_independent_set(g)), ids(ap.max_clique(g))
        assert all(a in cover or b in cover for a, b in e)
        assert not any(a in free and b in free for a, b in e)
        assert all(frozenset(p) in pairs for p in itertools.combinations(clique, 2))
        m = [(r["u"], r["v"]) for r in ap.min_maximal_matching(g).collect()]
        assert len({x for p in m for x in p}) == 2 * len(m)
        for f in (cm.label_propagation, cm.infomap, cm.louvain):
            assert set(d(f(g))) == set(range(14))
        assert len({v for v in d(cm.spectral_clustering(g, 3)).values()}) <= 3
        tour, cost = ap.greedy_tsp(g, 0)
        assert tour[0] == tour[-1] == 0 and len(tour) == 15 and cost > 0


def test_directed_shapes(spark):
    g = Graph.from_lists(spark, range(4), [(0, 1), (1, 2), (2, 0), (2, 3)], True)
    assert d(co.strongly_connected_components(g)) == {0: 0, 1: 0, 2: 0, 3: 3}
    assert not va.is_dag(g)
    with pytest.raises(HasCycle):
        va.require_dag(g)
    assert va.is_dag(Graph.from_lists(spark, range(3), [(0, 1), (1, 2)], True))
    with pytest.raises(InvalidGraph):
        va.require_connected(Graph.from_lists(spark, [0, 1], []))
    with pytest.raises(InvalidGraph):
        ce.closeness_centrality(Graph.empty(spark))


def test_generators_are_seeded(spark):
    e = lambda g: sorted(tuple(r) for r in g.edges.select("src", "dst").collect())
    for f in (lambda s: ge.erdos_renyi_graph(spark, 20, 0.3, s), lambda s: ge.watts_strogatz_graph(spark, 20, 4, 0.5, s), lambda s: ge.barabasi_albert_graph(spark, 20, 2, s)):
        assert e(f(1)) == e(f(1)) != e(f(2))
    assert ge.watts_strogatz_graph(spark, 20, 4, 0.5, 1).edge_count() == 40
    with pytest.raises(InvalidArgument):
        ge.watts_strogatz_graph(spark, 10, 3, 0.1)
    assert va.is_connected(ge.random_tree(spark, 30, 2))
