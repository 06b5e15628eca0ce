"""Substring dedup over bytes with a blockwise suffix array.

Strings that may repeat are dealt into blocks (see :mod:`repeats`).  In a block the
suffixes that start a window are ordered by difference-cover sorting: the suffixes at
cover positions are ranked first; then one bucket of suffixes after another is sorted
on its first V bytes, and suffixes that agree on those are ordered by the ranks of two
cover positions at one distance behind both.  Windows that repeat are neighbours in
this order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import apply_hits, covered, repeated_windows, row_id

#: Period of the difference cover: suffixes are compared directly on that many bytes.
V = 64
#: Bytes of a minimiser.
M = 32
#: Suffixes of a bucket (more only if they begin with the same 8 bytes).
BUCKET = 1 << 18


def difference_cover(v: int) -> tuple[list[int], np.ndarray]:
    """A set D of residues whose differences give all residues mod v (greedy), and for
    residues (a, b) the least d with a + d and b + d both in D modulo v."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = lambda x: len({(x - c) % v for c in cover} & missing | {(c - x) % v for c in cover} & missing)
        best = max((x for x in range(v) if x not in cover), key=gain)
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    inside = np.zeros(v, bool)
    inside[cover] = True
    d = np.arange(v)
    both = inside[(d[:, None, None] + d) % v] & inside[(d[None, :, None] + d) % v]
    return sorted(cover), both.argmax(axis=2).astype(np.int64)


COVER, SHIFT = difference_cover(V)


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each element) by several keys, the first one foremost."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of the suffix at every cover position by at least ``depth`` bytes; -1 elsewhere.

    Cover positions are ranked on V bytes, then ranks are doubled: the position V, 2 V,
    ... behind a cover position is one too.  ``words``: the 8 bytes from each position.
    """
    inside = np.zeros(V, bool)
    inside[COVER] = True
    at = np.flatnonzero(inside[np.arange(n) % V])
    rank = np.full(len(words) + 4 * depth + V, -1, np.int64)
    order = np.argsort(words[at], kind="stable")
    order = _refine(words, at, order, 8, V)
    new = np.zeros(len(at), bool)
    for i in range(0, V, 8):
        w = words[at[order] + i]
        new[1:] |= w[1:] != w[:-1]
    r = np.empty(len(at), np.int64)
    r[order] = np.cumsum(new)
    rank[at] = r
    size = V
    while size < depth:
        _, r = _dense([r, rank[at + size]])
        rank[at] = r
        size *= 2
    return rank


def _refine(words: np.ndarray, at: np.ndarray, order: np.ndarray, done: int, depth: int) -> np.ndarray:
    """Sorts on by bytes ``done`` to ``depth`` what is equal so far; ``order`` sorts ``at`` by ``done`` bytes."""
    order = order.copy()
    tie = np.arange(len(order))
    w = words[at[order]]
    group = np.cumsum(np.concatenate(([0], (w[1:] != w[:-1]).astype(np.int64))))
    while done < depth and len(tie):
        # Keep only groups of several.
        count = np.bincount(group)
        tie_keep = count[group] > 1
        tie, group = tie[tie_keep], group[tie_keep]
        if not len(tie):
            break
        members = order[tie]
        w = words[at[members] + done]
        _, small = np.unique(w, return_inverse=True)
        _, group = np.unique(group, return_inverse=True)
        key = group.astype(np.int64) * (small.max() + 1) + small
        inner = np.argsort(key, kind="stable")
        order[tie] = members[inner]
        key = key[inner]
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
        done += 8
    return order


def _network(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Comparators of Batcher's odd-even merge sort of ``size`` (a power of two) elements, step by step."""
    steps = []
    p = 1
    while p < size:
        k = p
        while k:
            i = np.arange(size - k)
            j = k % p
            block = i - j
            use = (block >= 0) & ((block // k) % 2 == 0) & (i // (2 * p) == (i + k) // (2 * p))
            steps.append((i[use], i[use] + k))
            k //= 2
        p *= 2
    return steps


def _greater(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is suffix a greater than b, both agreeing on V bytes?  Negative places are greater than all."""
    d = SHIFT[a % V, b % V]
    return np.where((a < 0) | (b < 0), (a < 0) & (b >= 0), rank[a + d] > rank[b + d])


def order_ties(members: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts each group (consecutive ``sizes`` of ``members``, agreeing on V bytes) by cover ranks."""
    out = members.copy()
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    for size in np.unique(width):
        some = np.flatnonzero(width == size)
        steps = _network(int(size))
        for i in range(0, len(some), max(1, (1 << 20) // int(size))):
            part = some[i : i + max(1, (1 << 20) // int(size))]
            place = at[part][:, None] + np.arange(size)
            there = np.arange(size) < sizes[part][:, None]
            grid = np.where(there, members[np.minimum(place, len(members) - 1)], -1)
            for x, y in steps:
                left, right = grid[:, x], grid[:, y]
                swap = _greater(rank, left, right)
                grid[:, x], grid[:, y] = np.where(swap, right, left), np.where(swap, left, right)
            out[place[there]] = grid[there]
    return out


def suffix_windows(contents: list[bytes], k: int) -> list[np.ndarray]:
    """For each string the flags of its k-byte windows that occur twice among all strings."""
    size = np.array([len(c) for c in contents], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    n, n_win = int(first[-1]), size - k + 1
    base = np.concatenate(([0], np.cumsum(n_win)))
    padded = np.zeros(n + 2 * k + 4 * V, np.uint8)
    padded[:n] = np.frombuffer(b"".join(contents), np.uint8)
    words = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        words |= padded[i : len(padded) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    starts = np.arange(base[-1]) + np.repeat(first[:-1] - base[:-1], n_win)
    flags = np.zeros(len(starts), bool)
    head = words[starts]
    order = np.argsort(head, kind="stable")
    sorted_head = head[order]
    rank = None
    a = 0
    while a < len(order):
        # The next bucket ends where the first 8 bytes change.
        z = min(len(order), a + BUCKET)
        if z < len(order):
            z = int(np.searchsorted(sorted_head, sorted_head[z - 1], "right"))
        bucket = _refine(words, starts, order[a:z], 8, V)
        at = starts[bucket]
        same = np.ones(len(at) - 1, bool)
        for i in range(0, V, 8):
            w = words[at + i]
            same &= w[1:] == w[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2] + 1
        if len(lo):
            if rank is None:
                rank = cover_ranks(words, n, k)
            sizes = hi - lo
            inside = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
            tied = order_ties(at[inside], sizes, rank)
            # Neighbours of one group that agree on all k bytes.
            x, y = tied[:-1], tied[1:]
            equal = np.ones(len(x), bool)
            equal[np.cumsum(sizes)[:-1] - 1] = False
            for i in [*range(V, k - 7, 8), k - 8]:
                left = np.flatnonzero(equal)
                equal[left] = words[x[left] + i] == words[y[left] + i]
            hit = np.zeros(len(tied), bool)
            hit[:-1] |= equal
            hit[1:] |= equal
            # From places in the block back to windows.
            place = tied[hit]
            owner = np.searchsorted(first, place, "right") - 1
            flags[place - first[owner] + base[owner]] = True
        a = z
    return np.split(flags, base[1:-1])


def _cut(k: int, want_bytes: bool):
    def run(texts: list[bytes], hits: list) -> list[pa.Array]:
        n, removed, spans, digests, kept = [], [], [], [], []
        for t, found in zip(texts, hits):
            gone = covered(len(t), found, k)
            left = t
            if found and gone.any():
                left = np.frombuffer(t, np.uint8)[~gone].tobytes()
            n.append(len(t))
            removed.append(len(t) - len(left))
            spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if found else 0)
            digests.append(hashlib.sha256(left).hexdigest())
            if want_bytes:
                kept.append(left)
        return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.binary())] if want_bytes else [])]

    return run


def suffix_dedup(docs: DataFrame, k: int = 200, id_col: str = "doc_id", text_col: str = "text", want_bytes: bool = True) -> DataFrame:
    """Removes every byte covered by a k-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; matches lie in one document and are judged on the input.
    All copies of a passage go.  Null text: no bytes; texts under k bytes stay as they
    are.  Ids may repeat or be null: rows are told apart by id and text.  An empty
    table gives an empty result.  Adds n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, if asked, kept_bytes (a cut may fall within a character).
    Columns of ``docs`` stay; those with one of the added names are replaced.
    """
    if k < V + 8 or k < M:
        raise ValueError(f"k must be at least {V + 8}")
    scratch = Scratch(docs.sparkSession, "suffix")
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if want_bytes else [])]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], row_id(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    hits = repeated_windows(rows.select("rid", "text"), "bytes", k, M, suffix_windows, scratch)
    out = apply_hits(rows, hits, _cut(k, want_bytes), "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * want_bytes, scratch)
    return out.toDF(*names, *added)


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs.select("doc_id", "text"), want_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
