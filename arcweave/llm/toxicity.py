"""Toxic text by a convolutional classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _TABLE_LOWER, PART, Scratch, cuts, pieces, prefix_sums, range_hash, small_batches
from .labelled import fold, training_sample

#: A word is looked up whole and by its first bytes, each in a hashed table of its own.
PREFIXES = (4, 5, 6, 7)
TABLE_BITS, TABLES, DIM = 17, 1 + len(PREFIXES), 6
#: Filters of each width (words).
WIDTHS, FILTERS = (1, 2, 3), 12
TRAIN_DOCS = 6000
#: Words whose responses are held at once in training.
SPAN = 1 << 15
#: Words and beginnings in fewer training texts than this are unknown, as are all that never occur there.
LEAST_DOCS = 5
#: Row of what is unknown, always zero.
UNKNOWN = TABLES << TABLE_BITS

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, TABLES) hashes of the words (runs of letters, A-Z lower-cased) of texts and of their
    beginnings (0 where a word is not longer), and each text's first word (one more at the end)."""
    inside = _LETTER[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    s = prefix_sums(_TABLE_LOWER[data], _BYTES)
    out = np.zeros((len(starts), TABLES), np.uint64)
    out[:, 0] = range_hash(s, starts, ends, _BYTES)
    for t, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > size)
        out[long, t] = range_hash(s, starts[long], starts[long] + size, _BYTES)
    return out, np.searchsorted(starts, off)


def table_rows(h: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Rows of the embedding table for hashes (words, TABLES); ``UNKNOWN`` unless ``live`` holds the hash's mark."""
    rows = (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64) + (np.arange(TABLES) << TABLE_BITS)
    rows[(live[rows] != _mark(h)) | (h == 0)] = UNKNOWN
    return rows


def _mark(h: np.ndarray) -> np.ndarray:
    """1 to 255: tells apart most hashes that share a row."""
    return (h >> np.uint64(40)).astype(np.uint8) | np.uint8(1)


@dataclass
class WordNet:
    embed: np.ndarray  # (UNKNOWN + 1, DIM)
    live: np.ndarray  # marks of the rows that training knew, else 0
    filters: list[np.ndarray]  # of each width w: (w, TABLES * DIM, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    out_bias: np.ndarray
    #: Language to threshold; "" for any other.
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> WordNet:
        r = np.random.default_rng(seed)
        n = lambda *s: r.standard_normal(s).astype(np.float32)
        return cls(n(UNKNOWN + 1, DIM) * 0.1, np.zeros(UNKNOWN + 1, np.uint8), [n(w, TABLES * DIM, FILTERS) * 0.3 for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), n(len(WIDTHS) * FILTERS) * 0.3, np.zeros(1, np.float32))


def responses(net: WordNet, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest response of each filter over each text, at least 0."""
    n_text = len(first) - 1
    top = np.zeros((n_text, len(WIDTHS) * FILTERS), np.float32)
    x = net.embed[rows].reshape(len(rows), -1)
    size = np.diff(first)
    for k, w in enumerate(WIDTHS):
        f = net.filters[k]
        if len(x) < w:
            continue
        act = x[: len(x) - w + 1] @ f[0]
        for j in range(1, w):
            act += x[j : len(x) - w + 1 + j] @ f[j]
        act += net.bias[k]
        fits = np.flatnonzero(size >= w)
        if not len(fits):
            continue
        # Windows that would look into the next text don't count.
        for j in range(1, w):
            last = first[1:] - j
            act[last[(last >= 0) & (last < len(act))]] = 0
        begin = first[:-1][fits]
        best = np.maximum.reduceat(act, begin, axis=0)
        # reduceat runs on to the next listed text: those between are shorter than w and count as 0.
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        top[fits, cols] = np.maximum(best, 0)
    return top


def located(net: WordNet, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest response of each filter over one text, at least 0; the word where its window begins, -1 for none)."""
    top = np.zeros((len(WIDTHS), FILTERS), np.float32)
    place = np.full(top.shape, -1, np.int64)
    for lo in range(0, len(words), SPAN):
        part = words[lo : lo + SPAN + max(WIDTHS) - 1]
        x = net.embed[part].reshape(len(part), -1)
        for k, w in enumerate(WIDTHS):
            m = min(SPAN, len(part) - w + 1)
            if m <= 0:
                continue
            act = sum(x[j : m + j] @ net.filters[k][j] for j in range(w)) + net.bias[k]
            at = act.argmax(axis=0)
            best = act[at, np.arange(FILTERS)]
            better = best > top[k]
            top[k][better], place[k][better] = best[better], lo + at[better]
    return top.ravel(), place


def _long_top(net: WordNet, data: np.ndarray) -> np.ndarray:
    """Largest responses over one long text, read part by part; the last words of a part go before the next one."""
    top, tail = np.zeros((1, len(WIDTHS) * FILTERS), np.float32), np.zeros((0, TABLES), np.int64)
    for part in cuts(data, PART):
        rows = np.concatenate((tail, table_rows(tokens(part, np.array([0, len(part)]))[0], net.live)))
        if len(rows):
            top = np.maximum(top, responses(net, rows, np.array([0, len(rows)])))
        tail = rows[max(0, len(rows) - max(WIDTHS) + 1) :]
    return top


def scores(net: WordNet, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text."""
    if len(off) == 2 and len(data) > PART:
        return _chance(_long_top(net, data) @ net.out + net.out_bias)
    h, first = tokens(data, off)
    if not len(h):
        z = np.repeat(net.out_bias, len(off) - 1)
    else:
        z = responses(net, table_rows(h, net.live), first) @ net.out + net.out_bias
    return _chance(z)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def gradients(net: WordNet, rows: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss over texts given as table rows.

    Returns those of the filters, biases, output weights and output bias; the rows of
    the embedding that take part; and their gradients.
    """
    parts = [located(net, r) for r in rows]
    top, place = np.stack([t for t, _ in parts]), np.stack([p for _, p in parts])
    g = ((_chance(top @ net.out + net.out_bias) - y) / len(rows)).astype(np.float32)
    d_filters, d_bias = [np.zeros_like(f) for f in net.filters], np.zeros_like(net.bias)
    d_top = g[:, None] * net.out
    d_top[top <= 0] = 0
    touched, d_words = [np.zeros((0, TABLES), np.int64)], [np.zeros((0, TABLES, DIM), np.float32)]
    for k, w in enumerate(WIDTHS):
        d = d_top[:, k * FILTERS : (k + 1) * FILTERS]
        text, filt = np.nonzero((d != 0) & (place[:, k] >= 0))
        window, grad = place[text, k, filt], d[text, filt]
        np.add.at(d_bias[k], filt, grad)
        for j in range(w if len(text) else 0):
            words = np.stack([rows[t][at] for t, at in zip(text, window + j)])
            np.add.at(d_filters[k].transpose(0, 2, 1)[j], filt, grad[:, None] * net.embed[words].reshape(len(words), -1))
            touched.append(words)
            d_words.append((grad[:, None] * net.filters[k][j].T[filt]).reshape(-1, TABLES, DIM))
    ids, at = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
    d_embed = np.zeros((len(ids), DIM), np.float32)
    np.add.at(d_embed, at.ravel(), np.concatenate(d_words).reshape(-1, DIM))
    d_embed[ids == UNKNOWN] = 0
    return [*d_filters, d_bias, top.T @ g, g.sum(keepdims=True)], ids, d_embed


def train(texts: list[bytes], labels: list[int], held: tuple[list[bytes], list[int]] = ([], []), epochs: int = 12, batch: int = 32, rate: float = 0.03, seed: int = 5) -> WordNet:
    """Fits the network by Adagrad; the same texts give the same network.

    Of the states after each epoch the one with the least log loss on ``held`` is kept.
    Without texts of both labels the network gives the share of label 1 (0.5 without any).
    """
    net = WordNet.fresh(seed)
    share = (sum(labels) + 1) / (len(labels) + 2)
    net.out_bias[:] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    seen: list[list[np.ndarray]] = [[] for _ in range(TABLES)]
    for text in texts:
        for t, h in enumerate(_tokens_of(text).T):
            seen[t].append(np.unique(h))
    for t in range(TABLES):
        found, times = np.unique(np.concatenate(seen[t]), return_counts=True)
        found = found[(times >= LEAST_DOCS) & (found > 0)]
        net.live[(found & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64) + (t << TABLE_BITS)] = _mark(found)
    del seen
    net.embed[net.live == 0] = 0
    rows = [table_rows(_tokens_of(t), net.live).astype(np.int32) for t in texts]
    y = np.array(labels, np.float32)
    r = np.random.default_rng(seed)
    g_embed = np.full(len(net.embed), 1e-8, np.float32)
    others = [*net.filters, net.bias, net.out, net.out_bias]
    grown = [np.full(p.shape, 1e-6, np.float32) for p in others]
    best, kept = np.inf, None
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            grads, ids, d = gradients(net, [rows[i] for i in part], y[part])
            for q, g, s in zip(others, grads, grown):
                s += g * g
                q -= rate * g / np.sqrt(s)
            g_embed[ids] += (d * d).sum(axis=1)
            net.embed[ids] -= rate * d / np.sqrt(g_embed[ids])[:, None]
        loss = _loss(net, *held)
        if loss is not None and loss < best:
            best, kept = loss, ([p.copy() for p in others], net.embed.copy())
    if kept:
        for p, q in zip(others, kept[0]):
            p[...] = q
        net.embed = kept[1]
    return net


def _loss(net: WordNet, texts: list[bytes], labels: list[int]) -> float | None:
    if not texts:
        return None
    p = np.clip(score_texts(net, texts), 1e-6, 1 - 1e-6)
    y = np.array(labels)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _tokens_of(text: bytes) -> np.ndarray:
    """Hashes of the words of one text, laid out part by part."""
    return np.concatenate([tokens(part, np.array([0, len(part)]))[0] for part in cuts(np.frombuffer(text, np.uint8), PART)])


def score_texts(net: WordNet, texts: list[bytes]) -> np.ndarray:
    """Scores of a list of texts."""
    return np.concatenate([scores(net, data, off) for _, _, data, off in pieces(pa.array(texts, pa.large_binary()), 1 << 18)] or [np.zeros(0)])


#: Bins of the score's logit, from -30 to 30, that thresholds are chosen from.
BINS = 12_000


def calibrate(net: WordNet, texts: list[bytes], labels: list[int], langs: list, least: int = 20) -> None:
    """Sets a threshold for each language from the scores of these texts (see ``set_thresholds``)."""
    s = score_texts(net, texts)
    at = np.clip(np.floor((np.log(s / (1 - s)) + 30) * (BINS / 60)), 0, BINS - 1).astype(int)
    set_thresholds(net, [(lang, b, 1, y) for lang, b, y in zip(langs, at.tolist(), labels)], least)


def set_thresholds(net: WordNet, counts: list[tuple], least: int = 20) -> None:
    """Sets a threshold for each language from (language, bin, texts, texts of label 1): the gap between bins that gives the best F1.

    Languages with fewer than ``least`` texts, or without both labels, take that over all texts.
    """
    edge = lambda b: 1 / (1 + np.exp(30 - b * (60 / BINS)))

    def best(rows: list[tuple]) -> float | None:
        at = np.array([r[1] for r in rows], np.int64)
        n, hit = (np.bincount(at, [r[k] for r in rows], BINS) for k in (2, 3))
        if n.sum() < least or not 0 < hit.sum() < n.sum():
            return None
        bins = np.flatnonzero(n)[::-1]
        k = int((2 * np.cumsum(hit[bins]) / (np.cumsum(n[bins]) + hit.sum())).argmax())
        return float((edge(bins[k]) + (edge(bins[k + 1] + 1) if k + 1 < len(bins) else 0)) / 2)

    net.thresholds = {"": (best(counts) if counts else None) or 0.3}
    for lang in sorted({r[0] for r in counts if r[0]}):
        t = best([r for r in counts if r[0] == lang])
        if t is not None:
            net.thresholds[lang] = t


def score_counts(scored: DataFrame, labels: DataFrame, use: F.Column, fitted: list = []) -> list[tuple]:
    """(language, bin, texts, texts of label 1) of all labelled rows of ``scored`` (doc_id, lang, score) where ``use`` holds.

    Rows of the ids ``fitted``, whose scores the fit has pulled apart, are left out.
    Only the counts come to the driver.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & use).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    if fitted:
        gone = scored.sparkSession.createDataFrame([(i,) for i in fitted], scored.select("doc_id").schema)
        rows = rows.join(F.broadcast(gone), "doc_id", "left_anti")
    at = F.floor((F.log(F.col("score") / (1 - F.col("score"))) + 30) * (BINS / 60))
    at = F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int")
    found = scored.join(rows, "doc_id").groupBy("lang", at.alias("at")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    return [tuple(r) for r in found.collect()]


def fit_network(docs: DataFrame, labels: DataFrame, use: F.Column, n: int = TRAIN_DOCS) -> tuple[WordNet, list]:
    """(a network fitted on at most ``n`` labelled rows, the ids it was fitted on); every fifth row is kept from the fit and tells when to stop."""
    found = training_sample(docs.withColumn("of", F.col("doc_id")), labels, "toxic", use, extra=["of"], n=n)
    fit, rest = [x for i, x in enumerate(found) if i % 5], found[::5]
    net = train([t for t, _, _ in fit], [y for _, y, _ in fit], ([t for t, _, _ in rest], [y for _, y, _ in rest]))
    return net, sorted({i for _, _, i in fit})


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: F.Column | None = None, n: int = TRAIN_DOCS) -> WordNet:
    """A network fitted on at most ``n`` labelled rows (``use`` restricts them by doc_id).

    Its thresholds are chosen over the whole texts of all other labelled rows, however many there are.
    """
    use = F.lit(True) if use is None else use
    net, fitted = fit_network(docs, labels, use, n)
    texts = docs.filter("text is not null").select("doc_id", "text", "lang").join(labels.filter(use).select("doc_id"), "doc_id", "left_semi")
    set_thresholds(net, score_counts(score_toxicity(texts, net).drop("text"), labels, use, fitted))
    return net


def score_toxicity(docs: DataFrame, net: WordNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col``, the probability of label 1 of every whole text; columns of ``docs`` stay.

    Null and empty texts get the score of no words; equal texts get equal scores.  A
    long text is read in parts.  Only the text is read for the score; ids may repeat or
    be null, and other columns may have any names.  An empty table gives an empty result.
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


def flag_toxic(scored: DataFrame, net: WordNet, lang_col: str = "lang", score_col: str = "score") -> DataFrame:
    """Adds ``flagged``: the score is at least its language's calibrated threshold (an unknown or null language takes the common one)."""
    limit = F.lit(net.thresholds.get("", 0.3))
    for lang, t in net.thresholds.items():
        if lang:
            limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return scored.withColumn("flagged", F.col(score_col) >= limit)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; every fourth fold of the ids is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    use = fold("doc_id", 4) != 2
    net, fitted = fit_network(docs, labels, use)
    # Scores are written once: thresholds are chosen from them and then applied to them.
    rows = docs.select("doc_id", "text", "lang", F.col("text").isNotNull().alias("real"))
    scored = Scratch(spark, "toxicity").keep(score_toxicity(rows, net).drop("text"))
    set_thresholds(net, score_counts(scored.filter("real"), labels, use, fitted))
    out = flag_toxic(scored, net)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")
