"""Sums of distances taken inside tasks: against the distances themselves, for whole and other weights, by both plans."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.operators import centrality as ce
from arcweave.plans import sources


def by_id(df):
    return {r[0]: r[1:] for r in df.collect()}


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("weights", [[1.0], [1.0, 2.0, 5.0, 64.0], [0.0, 1.0, 3.0], [0.25, 0.5, 7.0], [1.0, 100.0]])
def test_sums_are_those_of_the_distances(spark, directed, weights):
    r = random.Random(len(weights) + directed)
    edges = [(r.randrange(80) * 7, r.randrange(80) * 7, r.choice(weights)) for _ in range(150)]
    g = Graph.from_lists(spark, [i * 7 for i in range(80)], edges, directed=directed)
    want = {}
    for x in sources.distances(g).filter("src <> id").collect():
        v = want.setdefault(x["src"], [0, 0.0, 0.0, 0])
        if x["dist"]:
            v[0], v[1], v[2] = v[0] + 1, v[1] + x["dist"], v[2] + 1 / x["dist"]
        else:
            v[3] += 1
    for plan in ("local", "distributed"):
        got = {k: [v[0], v[1] or 0.0, v[2] or 0.0, v[3]] for k, v in by_id(sources.distance_sums(g, plan)).items() if v[0] or v[3]}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_closeness_moves_no_pairs(spark, monkeypatch):
    """No table of all pairs of vertices is formed where the graph can be broadcast."""

    def never(*_, **__):
        raise AssertionError("all pairs were formed")

    monkeypatch.setattr(sources, "distances", never)
    g = Graph.from_lists(spark, range(200), [(i, (i + 1) % 200) for i in range(200)])
    want = 199 / sum(min(k, 200 - k) for k in range(1, 200))
    assert all(v == pytest.approx(want) for (v,) in by_id(ce.closeness_centrality(g)).values())
    assert ce.harmonic_centrality(g).agg(F.min("harmonic")).first()[0] == pytest.approx(sum(1 / min(k, 200 - k) for k in range(1, 200)))
