"""Sequential heuristics against plain replays of their rules, and within bounded time on graphs of a few thousand vertices."""

import random
import time

import pytest

from arcweave.errors import AlgorithmError
from arcweave.graph import Graph
from arcweave.operators import approximation as ap


def drawn(seed, n, m, joined=False):
    r = random.Random(seed)
    e = {(a * 3, b * 3) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))}
    e |= {(i * 3, i * 3 + 3) for i in range(n - 1)} if joined else set()
    return [i * 3 for i in range(n)], [(a, b, float(r.randint(0, 3))) for a, b in sorted(e)]


def near_of(nodes, edges):
    near = {v: set() for v in nodes}
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def cliques(nodes, edges):
    near, left, out, k = near_of(nodes, edges), set(nodes), [], 0
    while left:
        best = set()
        for seed in sorted(left):
            c = {seed}
            for v in sorted(near[seed] & left, key=lambda x: (-len(near[x]), x)):
                if c <= near[v]:
                    c.add(v)
            best = c if len(c) > len(best) else best
        out += [(k, v) for v in sorted(best)]
        left -= best
        k += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_clique_removal_follows_its_rule(spark, seed):
    nodes, edges = drawn(seed, 25, 40 + 40 * seed)
    assert sorted(map(tuple, ap.clique_removal(Graph.from_lists(spark, nodes, edges)).collect())) == cliques(nodes, edges)


def test_clique_removal_of_many_vertices(spark):
    nodes, edges = drawn(7, 20000, 60000)
    began = time.time()
    rows = ap.clique_removal(Graph.from_lists(spark, nodes, edges)).collect()
    assert sorted(r["id"] for r in rows) == nodes and time.time() - began < 60


def eliminated(nodes, edges, fill):
    near, width, order = near_of(nodes, edges), 0, []
    while near:
        def price(v):
            x = sorted(near[v])
            return sum(b not in near[a] for i, a in enumerate(x) for b in x[i + 1 :]) if fill else len(x)

        v = min(near, key=lambda x: (price(x), x))
        around = near.pop(v)
        width = max(width, len(around))
        order.append(v)
        for a in around:
            near[a] = (near[a] | around) - {a, v}
    return width, order


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("wide", [None, 1])
def test_elimination_follows_its_rule(spark, monkeypatch, seed, wide):
    if wide:
        monkeypatch.setattr(ap, "WIDE", wide)
    nodes, edges = drawn(seed, 20, 20 + 20 * seed)
    g = Graph.from_lists(spark, nodes, edges)
    assert ap.treewidth_min_degree(g) == eliminated(nodes, edges, False)
    assert ap.treewidth_min_fill_in(g) == eliminated(nodes, edges, True)


def test_elimination_of_a_thousand_vertices(spark):
    nodes, edges = drawn(7, 1000, 3400)
    began = time.time()
    width, order = ap.treewidth_min_fill_in(Graph.from_lists(spark, nodes, edges))
    assert sorted(order) == nodes and width > 100 and time.time() - began < 20


def tour_of(nodes, edges, at):
    far = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, w in edges:
        far[a, b], far[b, a] = min(far[a, b], w), min(far[b, a], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    tour, left = [at], set(nodes) - {at}
    while left:
        v = min(left, key=lambda x: (far[tour[-1], x], x))
        tour.append(v)
        left.discard(v)
    tour.append(at)
    return tour, sum(far[a, b] for a, b in zip(tour, tour[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_greedy_tsp_follows_its_rule(spark, seed):
    # Half of the graphs have edges of no length.
    nodes, edges = drawn(seed, 18, 20, joined=True)
    edges = edges if seed % 2 else [(a, b, w + 1) for a, b, w in edges]
    assert ap.greedy_tsp(Graph.from_lists(spark, nodes, edges), nodes[2]) == tour_of(nodes, edges, nodes[2])


def test_greedy_tsp_of_many_vertices(spark):
    nodes, edges = drawn(7, 8000, 24000, joined=True)
    edges = [(a, b, w + 1) for a, b, w in edges]
    began = time.time()
    tour, _ = ap.greedy_tsp(Graph.from_lists(spark, nodes, edges), 0)
    assert sorted(tour[1:]) == nodes and time.time() - began < 60
    with pytest.raises(AlgorithmError):
        ap.greedy_tsp(Graph.from_lists(spark, [*nodes, 1], edges), 0)
