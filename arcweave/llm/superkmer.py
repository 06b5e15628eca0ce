"""Substring dedup over words by super-k-mer partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORDS, PART, Scratch, cuts, prefix_sums, range_hash, word_hashes, word_spans
from .repeats import apply_hits, covered, repeated_windows, row_id

#: Words of a minimiser.
M = 8


def count_windows(contents: list[bytes], k: int) -> list[np.ndarray]:
    """For each super-k-mer the flags of its windows whose words occur twice among all.

    Windows are sorted by a hash of their words; within a run of equal hashes the
    words themselves are compared.
    """
    data = np.frombuffer(b" ".join(contents), np.uint8)
    raw = data.tobytes()
    size = np.array([len(c) for c in contents], np.int64)
    at = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    starts, ends, first = word_spans(data, np.append(at, len(data)))
    n_win = np.diff(first) - k + 1
    base = np.concatenate(([0], np.cumsum(n_win)))
    window = np.arange(base[-1]) + np.repeat(first[:-1] - base[:-1], n_win)
    h = range_hash(prefix_sums(word_hashes(data, starts, ends), _WORDS), window, window + k, _WORDS)
    order = np.argsort(h)
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    flags = np.zeros(len(h), bool)
    text = lambda x: raw[starts[window[x]] : ends[window[x] + k - 1]]
    groups = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    for a, z in zip(groups[::2], groups[1::2]):
        members = order[a : z + 1].tolist()
        words = [text(x) for x in members]
        if all(w == words[0] for w in words):
            flags[members] = True
        else:
            times: dict[bytes, int] = {}
            for w in words:
                times[w] = times.get(w, 0) + 1
            for x, w in zip(members, words):
                flags[x] = times[w] > 1
    return np.split(flags, base[1:-1])


def _cut(k: int, want_text: bool):
    def run(texts: list[bytes], hits: list) -> list[pa.Array]:
        n, removed, digests, kept = [], [], [], []
        for t, found in zip(texts, hits):
            # Long texts are split into words part by part.
            parts = [t] if len(t) <= PART else [p.tobytes() for p in cuts(np.frombuffer(t, np.uint8), PART)]
            counts = [len(p.split()) for p in parts]
            gone = covered(sum(counts), found, k)
            some = bool(gone.any())
            digest, at, left = hashlib.sha256(), 0, 0
            for p, m in zip(parts, counts):
                words = p.split()
                if some:
                    words = [w for w, g in zip(words, gone[at : at + m]) if not g]
                if words:
                    digest.update((b" " if left else b"") + b" ".join(words))
                at, left = at + m, left + len(words)
            n.append(at)
            removed.append(at - left)
            digests.append(digest.hexdigest())
            if want_text:
                kept.append(_without(t, gone).decode() if some else t.decode())
        return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if want_text else [])]

    return run


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that go and the white space behind them."""
    data = np.frombuffer(text, np.uint8)
    starts, _, _ = word_spans(data, np.array([0, len(data)]))
    stop = np.append(starts[1:], len(data))
    keep = np.ones(len(data), bool)
    for a, z in zip(starts[gone], stop[gone]):
        keep[a:z] = False
    return data[keep].tobytes()


def substring_dedup(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text", want_text: bool = True, carry_text: bool = True) -> DataFrame:
    """Removes every word covered by a k-word window whose words also start anywhere else.

    Words are compared unchanged; windows lie in one document and are judged on the
    input.  All copies of a passage go.  Null text: no words, and the kept text is
    empty; texts of fewer than k words stay as they are.  Ids may repeat or be null:
    rows are told apart by id and text.  An empty table gives an empty result.  Adds
    n_words, n_removed, kept_sha256 (kept words joined by one space) and, if asked,
    kept_text (the text without the removed words, other white space as it was).
    Columns of ``docs`` stay (the text only if ``carry_text``); those with one of the
    added names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "superkmer")
    added = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if want_text else [])]
    names = [c for c in docs.columns if c not in added and (carry_text or c != text_col)]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], row_id(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    hits = repeated_windows(rows.select("rid", "text"), "words", k, min(M, k), count_windows, scratch)
    out = apply_hits(rows, hits, _cut(k, want_text), "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * want_text, scratch)
    return out.toDF(*names, *added)


def op4_superkmer(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs.select("doc_id", "text"), want_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
