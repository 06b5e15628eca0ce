"""op1: what counts as the same text."""

from arcweave.llm import packing


def test_copies_that_differ_in_outer_white_space_are_one_cluster(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "\na  B\t", " a\tb\n", "a c"])], "i long, t string")
    got = [r[0] for r in rows.coalesce(1).select(packing.exact_cluster(packing.F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] != got[3]
