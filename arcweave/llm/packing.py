"""Conflict-constrained best-fit packing of documents into fixed-size bins."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words

#: A source or cluster with more than this share of a shard's items is tracked level by level.
HOT_SHARE = 1 / 32
#: Items packed together in one task.
SHARD_ROWS = 40_000
RESULT = "doc_id long, piece int, start long, size long, bin long, bin_offset int, bin_fill int"


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> list[int]:
    """The bin of each item, items taken in the given order.

    An item goes to the open bin with the least residual that holds it and holds no
    item of its source nor of its cluster (None: no conflict); among equal residuals to
    one of the bins that came there late, the same at every run; with no such bin to a
    new one.

    Bins stand by residual.  Each carries a bitmap of its sources and one of its
    clusters.  The successor search walks up the residuals that are in use, as bits of
    one integer; for a frequent source or cluster a second integer marks the residuals
    with a bin free of it, so bins that it fills are never walked through.
    """
    many = {k for k, n in Counter(c for c in clusters if c is not None).items() if n > 1}
    bit: dict[tuple, int] = {}
    keys = []  # per item: (source bit, cluster bit)
    for s, c in zip(sources, clusters):
        sb = 0 if s is None else 1 << bit.setdefault(("s", s), len(bit))
        cb = 0 if c is None or c not in many else 1 << bit.setdefault(("c", c), len(bit))
        keys.append(sb | cb)
    # Source and cluster bits stand in one bitmap; one test finds either conflict.
    counts = Counter()
    for s in sources:
        if s is not None:
            counts[1 << bit["s", s]] += 1
    for c in clusters:
        if c is not None and c in many:
            counts[1 << bit["c", c]] += 1
    hot = [b for b, n in counts.items() if n > max(8, len(sizes) * HOT_SHARE)]
    hot_mask = sum(hot)
    free = {b: 0 for b in hot}  # residuals with a bin free of the key
    n_free = {b: [0] * (capacity + 1) for b in hot}
    used = 0  # residuals in use
    levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> hot bits -> bins
    masks: list[int] = []
    out = []
    for size, key in zip(sizes, keys):
        found = used >> size << size
        mine = key & hot_mask
        for b in hot:
            if b & mine:
                found &= free[b]
        chosen = level = None
        while found and chosen is None:
            level = (found & -found).bit_length() - 1
            for marks, bins in levels[level].items():
                if marks & mine:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not masks[bins[i]] & key:
                        chosen = bins.pop(i)
                        break
                if chosen is not None:
                    break
            found &= found - 1
        if chosen is None:
            chosen, level = len(masks), capacity
            masks.append(0)
        else:
            if not levels[level][marks]:
                del levels[level][marks]
                if not levels[level]:
                    used &= ~(1 << level)
            for b in hot:
                if not marks & b:
                    n_free[b][level] -= 1
                    if not n_free[b][level]:
                        free[b] &= ~(1 << level)
        masks[chosen] |= key
        rest = level - size
        if rest:
            marks = masks[chosen] & hot_mask
            levels[rest].setdefault(marks, []).append(chosen)
            used |= 1 << rest
            for b in hot:
                if not marks & b:
                    n_free[b][rest] += 1
                    free[b] |= 1 << rest
        out.append(chosen)
    return out


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id"], kind="stable")
        whole = (pdf["words"] // capacity).to_numpy()
        rest = (pdf["words"] % capacity).to_numpy()
        # Whole pieces fill bins of their own, numbered first.
        owner = np.repeat(np.arange(len(pdf)), whole)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        none = lambda s: [None if v is None or v != v else v for v in s.astype(object).to_numpy()[order].tolist()]
        local = np.array(best_fit(rest[order].tolist(), none(pdf["source"]), none(pdf["cluster"]), capacity), np.int64) + len(owner)
        at = np.concatenate((owner, order))
        out = pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(pdf["doc_id"].to_numpy(np.int64)[at], pdf["no_id"].to_numpy(bool)[at]),
                "piece": np.concatenate((piece, whole[order])).astype(np.int32),
                "size": np.concatenate((np.full(len(owner), capacity), rest[order])).astype(np.int64),
                "bin": np.concatenate((np.arange(len(owner)), local)),
            }
        )
        out["start"] = out["piece"].astype(np.int64) * capacity
        by = out.groupby("bin")["size"]
        out["bin_offset"] = (by.cumsum() - out["size"]).astype(np.int32)
        out["bin_fill"] = by.transform("sum").astype(np.int32)
        out["bin"] += int(pdf["shard"].iloc[0]) << 32
        return out[["doc_id", "piece", "start", "size", "bin", "bin_offset", "bin_fill"]]

    return run


def exact_cluster(text) -> F.Column:
    """A cluster of documents equal but for case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: F.Column | None = None,
) -> DataFrame:
    """Packs all documents into bins of ``capacity`` words.

    No bin holds two pieces of one source or of one duplicate cluster (``cluster``, by
    default documents equal but for case and white space).  A document longer than a
    bin is cut: its whole pieces fill bins of their own, the rest is packed.  Best fit,
    largest first, runs within shards of about ``SHARD_ROWS`` pieces chosen by a hash
    of the id, so no source or cluster gathers in one task; each shard leaves a few
    open bins of its own.

    A null or wordless text has one row with size 0 and bin null.  A null source
    conflicts with none.  Rows with one id and equal rows are packed each for itself
    (and conflict as copies).  A null id is allowed.  An empty table gives an empty
    result.  Other columns are not read.  Returns a row a piece: doc_id, piece (from
    0), start (word), size, bin, bin_offset (word), bin_fill (words in the bin).
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(exact_cluster(F.col(text_col)) if cluster is None else cluster, F.lit(0).cast("long")).alias("cluster"),
        n_words(F.col(text_col)).alias("words"),
    )
    empty = rows.filter("words = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("bin_offset"), F.lit(None).cast("int").alias("bin_fill"))
    shards = max(1, math.ceil(docs.count() / SHARD_ROWS))
    # pandas would turn ids with nulls among them into floats.
    items = rows.filter("words > 0").select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "words", "source", "cluster", F.xxhash64("doc_id", "cluster", "words").alias("turn"))
    items = items.withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int"))
    packed = items.groupBy("shard").applyInPandas(_pack(capacity), RESULT)
    return packed.unionByName(empty)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
