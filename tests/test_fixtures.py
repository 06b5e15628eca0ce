"""Named graphs hold what their tables hold."""

import pandas as pd

from arcweave.fixtures import load

SF = "/root/testdata/sf0.01"


def test_nation_trade_keeps_every_pair_and_line(spark):
    read = lambda t, *c: pd.read_parquet(f"{SF}/{t}.parquet", columns=list(c))
    lines = read("lineitem", "l_orderkey", "l_suppkey").merge(read("orders", "o_orderkey", "o_custkey"), left_on="l_orderkey", right_on="o_orderkey")
    lines = lines.merge(read("customer", "c_custkey", "c_nationkey"), left_on="o_custkey", right_on="c_custkey").merge(read("supplier", "s_suppkey", "s_nationkey"), left_on="l_suppkey", right_on="s_suppkey")
    want = lines.groupby(["s_nationkey", "c_nationkey"]).size()
    found = load(spark, SF, "nation_trade").edges.toPandas().set_index(["src", "dst"])["weight"]
    assert len(found) == len(want) == 625 and found.sum() == len(lines) == 60000
    assert found.to_dict() == want.astype(float).to_dict()
