"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a classifier is fitted on.
TRAIN_DOCS = 4000


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts`` (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(parts)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, use: F.Column, extra: list[str] = [], n: int = TRAIN_DOCS) -> list[tuple]:
    """At most ``n`` (bytes of the whole text, label, extra columns...) of labelled rows where ``use`` holds.

    The rows are those with the least hashes of their ids, so reruns agree; null
    labels, null ids and null texts are left out.  Labels are reduced to ``n`` rows
    before they meet the texts, which bounds what is broadcast and collected.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & use).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = docs.filter("text is not null").select("doc_id", F.col("text"), *extra)
    found = texts.join(F.broadcast(rows), "doc_id").select("doc_id", "y", "text", *extra)
    out = found.orderBy(F.xxhash64("doc_id"), "text").limit(n).collect()
    return [(r["text"].encode(), r["y"], *(r[c] for c in extra)) for r in out]
