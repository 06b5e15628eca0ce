"""op8: thresholds are chosen over all labelled whole texts, not over a sample."""

import pytest
from pyspark.sql import functions as F

from arcweave.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    # 300 English rows and 60 of a rare language; every third is toxic, half of these late in a long text.
    rows = []
    for i in range(360):
        bad = "awful hateful words" if i % 3 == 0 else "calm friendly words"
        rows.append((i, ("quiet and plain " * (2000 if i % 6 == 0 else 2)) + bad, "xx" if i % 6 < 1 or i >= 300 and i % 6 == 1 else "en", int(i % 3 == 0)))
    rows.append((360, None, "xx", 1))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_a_rare_language_gets_its_threshold_from_all_its_labels(tables):
    docs, labels = tables
    net = toxicity.fit_toxicity(docs, labels, n=80)
    assert set(net.thresholds) == {"", "en", "xx"}


def test_every_labelled_row_outside_fit_and_fold_counts_once(tables):
    docs, labels = tables
    use = F.col("doc_id") % 4 != 2
    net, fitted = toxicity.fit_network(docs, labels, use, 80)
    assert 0 < len(fitted) <= 64
    scored = toxicity.score_toxicity(docs.filter("text is not null"), net).drop("text")
    counts = toxicity.score_counts(scored, labels, use, fitted)
    rest = [i for i in range(360) if i % 4 != 2 and i not in set(fitted)]
    assert sum(r[2] for r in counts) == len(rest) and sum(r[3] for r in counts) == sum(i % 3 == 0 for i in rest)


def test_threshold_parts_the_labels_at_both_ends_of_the_scale():
    net = toxicity.WordNet.fresh(1)
    edge = lambda p: int((toxicity.np.log(p / (1 - p)) + 30) * toxicity.BINS / 60)
    low = [("a", edge(1e-6), 30, 0), ("a", edge(1e-5), 30, 30)]
    high = [("b", edge(1 - 1e-5), 30, 0), ("b", edge(1 - 1e-6), 30, 30)]
    toxicity.set_thresholds(net, low + high)
    assert 1e-6 < net.thresholds["a"] < 1e-5 and 1 - 1e-5 < net.thresholds["b"] < 1 - 1e-6
