"""The pipeline stage by stage against plain forms of each decision."""

import corpus_pipeline as cp
from arcweave.llm import packing, quality

from .test_dedup import brute_near, brute_words


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < len(cp.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    first, second, third = rows(seen[1]), rows(seen[2]), rows(seen[3])
    net = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(first) == {r["doc_id"] for r in quality.score_documents(docs, net).collect() if r["score"] >= 0.5}
    assert set(second) == {i for i, x in brute_near(list(first.items()), 5).items() if x[2]}
    cut = brute_words(list(second.items()))
    assert set(third) == {i for i, (n, gone, _) in cut.items() if gone == 0 or gone < n}
    for i, t in third.items():
        assert len(t.split()) <= cut[i][0] and len(t.encode().split()) == cut[i][0] - cut[i][1]
    packed = seen[5].collect()
    assert sum(r["size"] for r in packed) == sum(len(r["text"].encode().split()) for r in seen[4].collect())
    assert {r["doc_id"] for r in packed} <= set(third) and packing.RESULT.count(",") + 1 == len(seen[5].columns)
