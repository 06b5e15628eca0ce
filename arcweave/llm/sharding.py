"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Slots of a shard are numbered slice by slice, by this many hexadecimal digits of a hash, so no task needs a whole shard.
SLICE_DIGITS = 3


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each 64-bit key.

    Each key jumps ahead through a pseudo-random walk of its own; the last jump below
    ``shards`` is its place.  With one shard more, a key stays or goes to the new one.
    """
    key = np.array(keys, dtype=np.uint64)
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = j < shards
    while going.any():
        b[going] = j[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        j[going] = ((b[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        going = j < shards
    return b


def jump_shards(shards: int):
    """A column function: (shard, shard with one more) of a long key column."""

    @F.pandas_udf("shard int, grown_shard int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            keys = s.to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump_hash(keys, shards).astype(np.int32), "grown_shard": jump_hash(keys, shards + 1).astype(np.int32)})

    return run


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, and place within its shard, of each document.

    The id and the number of shards decide the shard (law ``key``), so rows of one id
    share a shard, whatever their texts; a null id counts as the empty string.  The key
    is the first half of the MD5 digest of the id as text.  ``grown_shard``
    is the shard if one more is appended.  ``slot`` numbers the rows of a shard from 0
    without gaps, in the order of the digest's second half, then the id, then the text's
    checksum and size; fully equal rows get different slots in any order.  Null text:
    no bytes, size 1.  An empty table gives an empty result.  Other columns are not
    read.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        jump_shards(shards)(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")).alias("__to"),
        F.substring(digest, 17, 16).alias("__turn"),
    )
    # Written once: both what is numbered and the numbers before each slice are read from it.
    rows = Scratch(docs.sparkSession, "sharding").keep(rows.select("doc_id", "size", "text_crc32", "__to.*", "__turn", F.substring("__turn", 1, SLICE_DIGITS).alias("__slice")))
    earlier = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**SLICE_DIGITS rows a shard.
    starts = rows.groupBy("shard", "__slice").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    within = Window.partitionBy("shard", "__slice").orderBy("__turn", "doc_id", "text_crc32", "size")
    out = rows.withColumn("__at", F.row_number().over(within)).join(starts.drop("__n"), ["shard", "__slice"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__first") + F.col("__at") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op10_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
