"""Kernels against plain forms on generated graphs; no Spark jobs."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.operators.centrality import _brandes
from arcweave.operators.components import _scc_kernel, union_find
from arcweave.operators.paths import _relax
from arcweave.plans.local import LocalGraph
from arcweave.plans.sources import bfs_levels, dijkstra

graphs = st.integers(1, 9).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 9)), max_size=25), st.booleans()))


def build(g):
    n, e, directed = g
    e = np.array(e, np.int64).reshape(-1, 3)
    # Ids have gaps, as after removals.
    return LocalGraph(np.arange(n) * 3 + 5, np.arange(len(e)), e[:, 0] * 3 + 5, e[:, 1] * 3 + 5, e[:, 2].astype(float), directed)


def closure(g):
    d = np.full((g.n, g.n), np.inf)
    s, t, w = g.arcs("out")
    np.minimum.at(d, (s, t), w)
    np.fill_diagonal(d, 0)
    for k in range(g.n):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    return d


@settings(max_examples=80, deadline=None)
@given(graphs)
def test_distances(x):
    g = build(x)
    d = closure(g)
    for s in range(g.n):
        assert np.array_equal(dijkstra(g, s)[0], d[s]) and np.array_equal(_relax(g, s), d[s])
        assert np.array_equal(bfs_levels(g, s) >= 0, np.isfinite(d[s]))


@settings(max_examples=80, deadline=None)
@given(graphs)
def test_components(x):
    g = build(x)
    d = closure(g)
    both = np.isfinite(d) & np.isfinite(d.T)
    assert np.array_equal(_scc_kernel(g)["component"].to_numpy(), g.ids[both.argmax(axis=1)])
    undirected = closure(LocalGraph(g.ids, g.eid, g.ids[g.src], g.ids[g.dst], g.weight, False))
    assert np.array_equal(union_find(g.n, g.src, g.dst), np.isfinite(undirected).argmax(axis=1))


@settings(max_examples=60, deadline=None)
@given(graphs)
def test_dependencies_sum_to_path_lengths(x):
    """Over all sources, inner vertices of shortest paths add up to hops less one per reached pair."""
    g = build(x)
    for s in range(g.n):
        depth = bfs_levels(g, s)
        inner = sum(k - 1 for k in depth.tolist() if k > 0)
        assert math.isclose(_brandes(g, s)[0].sum(), inner, abs_tol=1e-9)
