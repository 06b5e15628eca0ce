"""Elimination orders in Java, against the same rule over sets and arrays, and on wide graphs."""

import random
import time

import pytest

from arcweave.graph import Graph
from arcweave.operators import approximation as ap


def partners(n, k, seed):
    r = random.Random(seed)
    return sorted({tuple(sorted((a, b))) for a in range(n) for b in r.sample(range(n), k) if a != b})


def grid(n):
    return [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j) for i in range(n - 1) for j in range(n)]


CASES = {
    "partners": (700, partners(700, 4, 3)),
    "apart": (400, [(a + s, b + s) for s in (0, 200) for a, b in partners(200, 5, 8)]),
    "grid": (324, grid(18)),
    "hubs": (300, [(h, v) for h in (0, 1, 299) for v in range(2, 299)] + partners(150, 2, 1)),
    "full": (70, [(a, b) for a in range(70) for b in range(a)]),
    "loops": (5, [(1, 1), (3, 3), (1, 3), (3, 1)]),
    "none": (3, []),
}


@pytest.mark.parametrize("case,wide", [(c, w) for c in CASES for w in (1, 12, 10_000) if c in ("partners", "hubs") or w == 1])
def test_same_order_in_java(spark, monkeypatch, case, wide):
    # A table of bits from the start, sets first, and sets alone.
    monkeypatch.setattr(ap, "WIDE", wide)
    n, edges = CASES[case]
    g = Graph.from_lists(spark, [5 * v - 7 for v in range(n)], [(5 * a - 7, 5 * b - 7) for a, b in edges])
    there = [f(g) for f in (ap.treewidth_min_degree, ap.treewidth_min_fill_in)]
    monkeypatch.setattr(ap, "register", lambda *_: None)
    assert there == [f(g) for f in (ap.treewidth_min_degree, ap.treewidth_min_fill_in)]


def test_no_vertices(spark):
    assert ap.treewidth_min_fill_in(Graph.from_lists(spark, [], [])) == (0, [])


def test_thousands_of_vertices_of_many_links(spark):
    # The kernel over sets and arrays alone took 46 s for both rules.
    n = 6000
    g = Graph.from_lists(spark, range(n), partners(n, 4, 5))
    start = time.time()
    for f in (ap.treewidth_min_degree, ap.treewidth_min_fill_in):
        width, order = f(g)
        assert width > 1000 and sorted(order) == list(range(n))
    assert time.time() - start < 12


def test_a_star_and_a_long_line(spark):
    # Leaves leave the hub's set one at a time.
    n = 60_000
    star = Graph.from_lists(spark, range(n), [(n - 1, v) for v in range(n - 1)])
    line = Graph.from_lists(spark, range(n), [(v, v + 1) for v in range(n - 1)])
    start = time.time()
    for f in (ap.treewidth_min_degree, ap.treewidth_min_fill_in):
        assert f(star) == (1, list(range(n))) and f(line) == (1, list(range(n)))
    assert time.time() - start < 40
