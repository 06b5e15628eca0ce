"""op3 and op8: held-out accuracy on the labelled test table; odd inputs."""

import random
import zlib

import numpy as np
import pytest

from arcweave.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def outcome(spark, name, label, parts, part, sf=SF, n=1000):
    rows = queries.QUERIES[name](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts == part)).all()
    assert rows["score"].between(0, 1).all() and len(rows) == n
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    return both["score"].to_numpy(), both[label].to_numpy(), both["predicted"].to_numpy()


def auc(s, y):
    order = np.argsort(np.argsort(s))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_quality(spark):
    s, y, p = outcome(spark, "op3_quality", "quality", 3, 1)
    assert auc(s, y) > 0.95 and (p == y).mean() > 0.95


def test_toxicity(spark):
    # A tenth of the labels are 1: the small table has too few to learn their words from.
    s, y, p = outcome(spark, "op8_toxicity", "toxic", 4, 2, "/root/testdata/sf0.1", 10_000)
    assert auc(s, y) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_depend_on_the_text_alone(module):
    texts = [b"good words here", b"", b"bad bad bad", b"x" * 5000, "é ü".encode()]
    net = module.train([b"good words here"] * 20 + [b"bad bad bad"] * 20, [1] * 20 + [0] * 20)
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = module.scores(net, data, off)
    for i, t in enumerate(texts):
        alone = module.scores(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert abs(alone - together[i]) < 1e-5
    assert together[0] > together[2]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_label_or_none(module):
    assert module.scores(module.train([b"a"], [1]), np.frombuffer(b"z", np.uint8), np.array([0, 1]))[0] > 0.5
    assert module.scores(module.train([], []), np.zeros(0, np.uint8), np.array([0, 0])).shape == (1,)


def test_odd_tables(spark, frame):
    rows = [(1, None), (None, "a"), (1, "a"), (1, "a"), (2, ""), (3, "a b " * 90_000)]
    docs = frame(rows).withColumn("c0", quality.F.lit(5)).withColumn("score", quality.F.lit("old"))
    net, tox = quality.train([b"a b", b"!!"], [1, 0]), toxicity.train([b"a b", b"!!"], [1, 0])
    tox.thresholds = {"": 0.5, "en": 0.1}
    for module, out in ((quality, quality.score_documents(docs, net)), (toxicity, toxicity.score_toxicity(docs, tox))):
        model = net if module is quality else tox
        alone = lambda t: module.scores(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]  # noqa: B023, E731
        got = [(r["doc_id"], r["text"], r["score"]) for r in out.collect()]
        assert [g[:2] for g in got] == rows and out.columns.count("score") == 1 and out.schema["score"].dataType.simpleString() == "double"
        # Each row by its text alone, a null as no text; other columns stay.
        assert all(abs(s - alone(t or "")) < 1e-5 for _, t, s in got) and got[1][2] == got[2][2] == got[3][2] and got[0][2] == got[4][2]
        assert {r["c0"] for r in out.collect()} == {5}
    flags = toxicity.flag_toxic(toxicity.score_toxicity(docs, tox), tox).collect()
    assert [r["flagged"] for r in flags] == [r["score"] >= 0.1 for r in flags]
    assert quality.score_documents(frame([]), net).count() == 0 and toxicity.score_toxicity(frame([]), tox).count() == 0


def test_calibration():
    net = toxicity.train([b"fine text", b"awful text"] * 30, [0, 1] * 30)
    toxicity.calibrate(net, [b"fine text", b"awful text"] * 30, [0, 1] * 30, ["en"] * 40 + ["fr"] * 20)
    assert set(net.thresholds) == {"", "en", "fr"}


def test_quality_gradients():
    r = np.random.default_rng(0)
    net = quality.ByteNet.fresh(1)
    texts, y = [bytes(r.integers(1, 255, 700).tolist()) for _ in range(3)], np.array([1, 0, 1], np.float32)

    def loss():
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        p = quality.scores(net, data, off)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality._step(net, texts, y)
    for part, g in zip(net.parts(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        part[at] += 1e-2
        up = loss()
        part[at] -= 2e-2
        down = loss()
        part[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-3


def plain_quality(net, text):
    """The network by loops: each place sees 2 * STEP bytes, chunks are two blocks with half overlap."""
    n, step, block = len(text), quality.STEP, quality.BLOCK
    blocks = -(-(n + step) // block)
    flat = list(text) + [0] * (blocks * block + step - n)
    tops = []
    for b in range(blocks):
        best = np.zeros(quality.FILTERS)
        for p in range(quality.PLACES):
            at = b * block + p * step
            if b < blocks - 1 or p < quality.PLACES - 1:
                seen = np.concatenate([net.embed[c] for c in flat[at : at + 2 * step]])
                best = np.maximum(best, seen @ net.filters + net.bias)
        tops.append(best)
    chunks = [np.maximum(a, z) for a, z in zip(tops, tops[1:])] or tops
    z = np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0))) @ net.out + net.out_bias[0]
    return 1 / (1 + np.exp(-z))


def plain_toxicity(net, text):
    """The network by loops over words, tables, widths."""
    h, _ = toxicity.tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    rows = toxicity.table_rows(h, net.live)
    x = [np.concatenate([net.embed[r] for r in word]) for word in rows]
    top = []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top.append(max([0.0] + [sum(x[i + j] @ net.filters[k][j][:, f] for j in range(w)) + net.bias[k][f] for i in range(len(x) - w + 1)]))
    return 1 / (1 + np.exp(-(np.array(top) @ net.out + net.out_bias[0])))


@pytest.mark.parametrize("module, plain", [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores_against_plain_loops(module, plain, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)).encode() for n in (0, 1, 2, 3, 40, 150, 300)]
    net = module.train(texts * 6, [i % 2 for i in range(len(texts) * 6)], epochs=2)
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    expected = [plain(net, t) for t in texts]
    assert np.abs(module.scores(net, data, off) - expected).max() < 1e-4
    # Read in small parts.
    monkeypatch.setattr(module, "SPAN", 3)
    monkeypatch.setattr(toxicity, "PART", 64)
    monkeypatch.setattr(quality, "SPAN", 2)
    alone = [module.scores(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.abs(np.array(alone) - expected).max() < 1e-4


def test_toxicity_gradients():
    r = random.Random(1)
    texts = [" ".join(r.choice(["aa", "bbbbb", "cc", "dddddddd", "e"]) for _ in range(n)).encode() for n in (1, 6, 30)]
    net = toxicity.WordNet.fresh(2)
    net.live[:] = 0
    hashes = [toxicity._tokens_of(t) for t in texts]
    for t in range(toxicity.TABLES):
        h = np.unique(np.concatenate([x[:, t] for x in hashes]))
        net.live[(h & np.uint64((1 << toxicity.TABLE_BITS) - 1)).astype(np.int64) + (t << toxicity.TABLE_BITS)] = toxicity._mark(h)
    net.embed[toxicity.UNKNOWN] = 0
    rows, y = [toxicity.table_rows(h, net.live) for h in hashes], np.array([1, 0, 1], np.float32)

    def loss():
        p = toxicity.score_texts(net, texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    def close(part, at, g):
        part[at] += 1e-2
        up = loss()
        part[at] -= 2e-2
        down = loss()
        part[at] += 1e-2
        assert abs((up - down) / 2e-2 - g) < 0.05 * abs(g) + 2e-3

    grads, ids, d = toxicity.gradients(net, rows, y)
    for part, g in zip([*net.filters, net.bias, net.out, net.out_bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        close(part, at, g[at])
    i, k = np.unravel_index(np.abs(d).argmax(), d.shape)
    close(net.embed, (ids[i], k), d[i, k])


def test_training_reads_whole_texts(spark):
    from arcweave.llm.labelled import training_sample

    long = "word " * 30_000 + "end"
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    got = training_sample(docs, labels, "quality", quality.F.lit(True))
    assert sorted(got) == sorted([(long.encode(), 1), (b"short", 0)])
