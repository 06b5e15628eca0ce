"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches
from .labelled import TRAIN_DOCS, fold, training_sample

#: Bytes of a step; a filter sees two steps, every step begins one place.
STEP = 8
#: Values a byte is embedded in, and number of filters.
DIM, FILTERS = 8, 24
#: Bytes of a block; a chunk is two consecutive blocks, so chunks overlap by half.
BLOCK = 256
PLACES = BLOCK // STEP
#: Blocks whose responses are held at once.
SPAN = 1024


@dataclass
class ByteNet:
    """Embedding (256, DIM), filters (2 * STEP * DIM, FILTERS), their bias, and the output layer."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> ByteNet:
        r = np.random.default_rng(seed)
        n = lambda *s: r.standard_normal(s).astype(np.float32)
        embed = n(256, DIM)
        embed[0] = 0
        return cls(embed, n(2 * STEP * DIM, FILTERS) / 8, np.zeros(FILTERS, np.float32), n(2 * FILTERS) / 10, np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in whole blocks with at least STEP zero bytes behind each; and the first block of each (one more at the end)."""
    size = np.diff(off)
    blocks = (size + STEP + BLOCK - 1) // BLOCK
    first = np.concatenate(([0], np.cumsum(blocks)))
    flat = np.zeros(int(first[-1]) * BLOCK + STEP, np.uint8)
    if len(size) == 1:
        flat[: len(data)] = data
        return flat, first
    place = np.repeat(first[:-1] * BLOCK - off[:-1], size) + np.arange(len(data))
    flat[place] = data
    return flat, first


def block_maxima(net: ByteNet, flat: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(largest response of each filter in each block, at least 0; if asked for, its place in the block).

    ``SPAN`` blocks are embedded at a time, so memory doesn't grow with the text.
    """
    n, half = int(first[-1]), STEP * DIM
    top = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int16) if places else None
    # The last place of a text would look into the next one.
    ends = np.unique(first[1:]) * PLACES - 1
    for lo in range(0, n, SPAN):
        hi = min(n, lo + SPAN)
        x = net.embed[flat[lo * BLOCK : hi * BLOCK + STEP]].reshape(-1, half)
        act = x[:-1] @ net.filters[:half]
        act += x[1:] @ net.filters[half:]
        act += net.bias
        act[ends[np.searchsorted(ends, lo * PLACES) : np.searchsorted(ends, hi * PLACES)] - lo * PLACES] = 0
        act = act.reshape(-1, PLACES, FILTERS)
        top[lo:hi] = act.max(axis=1)
        if places:
            where[lo:hi] = act.argmax(axis=1)
    return np.maximum(top, 0, out=top), where


def pooled(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each text, chunk maxima, first chunk of each text): chunks are two blocks, or one where a text has one.

    A text's features are the largest of its chunk maxima and their mean.
    """
    n = np.diff(first)
    chunks = np.maximum(n - 1, 1)
    at = np.concatenate(([0], np.cumsum(chunks)))
    left = np.repeat(first[:-1] - at[:-1], chunks) + np.arange(at[-1])
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, chunks))
    chunk = np.maximum(top[left], top[right])
    best = np.maximum.reduceat(chunk, at[:-1], axis=0)
    mean = np.add.reduceat(chunk, at[:-1], axis=0) / chunks[:, None]
    return np.concatenate((best, mean), axis=1).astype(np.float32), chunk, at


def scores(net: ByteNet, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text (bytes ``data[off[i]:off[i + 1]]``)."""
    if len(off) < 2:
        return np.zeros(0)
    flat, first = layout(data, off)
    z = pooled(block_maxima(net, flat, first)[0], first)[0] @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _step(net: ByteNet, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    flat, first = layout(data, off)
    top, where = block_maxima(net, flat, first, places=True)
    feats, chunk, at = pooled(top, first)
    p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.out_bias, -30, 30)))
    g = ((p - y) / len(y)).astype(np.float32)
    d_out, d_out_bias = feats.T @ g, g.sum(keepdims=True)
    d_feats = g[:, None] * net.out
    # To chunks: the best chunk of each text, and all of them for the mean.
    chunks = np.diff(at)
    d_chunk = np.repeat(d_feats[:, FILTERS:] / chunks[:, None], chunks, axis=0)
    for i in range(len(texts)):
        best = chunk[at[i] : at[i + 1]].argmax(axis=0)
        d_chunk[at[i] + best, np.arange(FILTERS)] += d_feats[i, :FILTERS]
    # To the block that gave a chunk's maximum, and to the place there.
    left = np.repeat(first[:-1] - at[:-1], chunks) + np.arange(at[-1])
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, chunks))
    source = np.where(top[left] >= top[right], left[:, None], right[:, None])
    d_top = np.zeros_like(top)
    np.add.at(d_top, (source, np.arange(FILTERS)), d_chunk)
    d_top[top <= 0] = 0
    block, filt = np.nonzero(d_top)
    grad = d_top[block, filt]
    place = block * PLACES + where[block, filt]
    window = flat[(place * STEP)[:, None] + np.arange(2 * STEP)]
    seen = net.embed[window].reshape(len(place), -1)
    d_filters, d_bias = np.zeros_like(net.filters), np.zeros_like(net.bias)
    for f in range(FILTERS):
        m = filt == f
        d_filters[:, f] = seen[m].T @ grad[m]
        d_bias[f] = grad[m].sum()
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, window.ravel(), (grad[:, None] * net.filters.T[filt]).reshape(-1, DIM))
    d_embed[0] = 0
    return [d_embed, d_filters, d_bias, d_out, d_out_bias]


def train(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 3) -> ByteNet:
    """Fits the network by Adam with a falling rate; the same texts give the same network.

    Without texts of both labels the network gives the share of label 1 (0.5 without any).
    """
    net = ByteNet.fresh(seed)
    share = (sum(labels) + 1) / (len(labels) + 2)
    net.out_bias[:] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    r, y = np.random.default_rng(seed), np.array(labels, np.float32)
    m, v, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for p, g, a, b in zip(net.parts(), _step(net, [texts[k] for k in part], y[part]), m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return net


def score_documents(docs: DataFrame, net: ByteNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col``, the probability of label 1 of every whole text; columns of ``docs`` stay.

    Null and empty texts get the score of no bytes; equal texts get equal scores.  A
    long text's bytes are held whole, its responses in bounded pieces.  Only the text
    is read for the score; ids may repeat or be null, and other columns may have any
    names.  An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != score_col]
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    schema = rows.drop("text").withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            s = [scores(shared.value, data, off) for _, _, data, off in pieces(b.column("text"), 1 << 18)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(np.concatenate(s) if s else np.zeros(0))], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema).toDF(*names, score_col)


def fit_quality(docs: DataFrame, labels: DataFrame, use: F.Column | None = None, n: int = TRAIN_DOCS) -> ByteNet:
    """A network fitted on at most ``n`` labelled rows; ``use`` restricts them by doc_id."""
    found = training_sample(docs, labels, "quality", F.lit(True) if use is None else use, n=n)
    return train([t for t, _ in found], [y for _, y in found])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; every third fold of the ids is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit_quality(docs, labels, fold("doc_id", 3) != 1)
    out = score_documents(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
