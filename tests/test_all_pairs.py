"""Scores of all pairs, written out inside tasks: against plain sets, and without a join of pairs."""

import random

import pytest

from arcweave.graph import Graph
from arcweave.operators import links as li


def drawn(spark, seed):
    r = random.Random(seed)
    nodes = [i * 5 - 20 for i in range(30)]
    edges = [(r.choice(nodes[:25]), r.choice(nodes[:25])) for _ in range(60)]
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in nodes}
    return Graph.from_lists(spark, nodes, edges), nodes, near


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def never_pairs(df):
    return not any(x in plan(df) for x in ("NestedLoop", "Cartesian"))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_all_pairs(spark, seed):
    g, nodes, near = drawn(spark, seed)
    df = li.jaccard_coefficient(g)
    want = {(u, v): len(near[u] & near[v]) / max(1, len(near[u] | near[v])) for u in nodes for v in nodes if u < v}
    rows = df.collect()
    assert len(rows) == len(want) and {(r["u"], r["v"]): r["score"] for r in rows} == pytest.approx(want)
    assert never_pairs(df) and df.columns == ["u", "v", "score"]


def test_cn_soundarajan_hopcroft_of_all_pairs(spark):
    g, nodes, near = drawn(spark, 3)
    df = li.cn_soundarajan_hopcroft(g, "pmod(id, 4)")
    want = {(u, v): float(sum(w % 4 == u % 4 == v % 4 for w in near[u] & near[v])) for u in nodes for v in nodes if u < v}
    assert {(r["u"], r["v"]): r["score"] for r in df.collect()} == want and never_pairs(df)


def test_ra_index_soundarajan_hopcroft_of_all_pairs(spark):
    g, nodes, near = drawn(spark, 4)
    df = li.ra_index_soundarajan_hopcroft(g, "pmod(id, 2)")
    degree = {r["id"]: r["deg"] for r in li._degrees(g).collect()}
    want = {(u, v): sum(1 / degree[w] for w in near[u] & near[v] if w % 2 == u % 2 == v % 2) for u in nodes for v in nodes if u < v}
    assert {(r["u"], r["v"]): r["score"] for r in df.collect()} == pytest.approx(want) and never_pairs(df)


def test_counts_stay_whole_and_empty_graphs_have_no_pairs(spark):
    g, _, _ = drawn(spark, 5)
    assert dict(li.common_neighbors(g).dtypes)["score"] == "bigint" and li.common_neighbors(g).filter("score > 0").count() == li.common_neighbors(g, nonzero=True).count()
    assert li.jaccard_coefficient(Graph.from_lists(spark, [], [])).count() == 0
