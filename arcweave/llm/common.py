"""Shared helpers: shared-folder tables, word arithmetic over Arrow buffers, a
fixed-size membership filter.

Words are ``[^\\x20\\x09-\\x0D]+``.  Texts are handled as UTF-8 bytes; a null text
counts as empty everywhere.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import Steps

#: SQL pattern of one word.
WORD = r"[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IS_WORD = ~_SPACE


# --------------------------------------------------------------------------- tables


class Scratch(Steps):
    """Written tables that cut lineage, compressed; ``drop`` removes what nothing reads any more."""

    def keep(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        return self.write(df, name=name, codec=codec)

    def release(self) -> None:
        """Has the driver forget unused plans, so that Spark deletes their shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets Spark hand Python at most ``most`` bytes at once, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key, "67108864") if c.isdigit()) or 0) != most:
        spark.conf.set(key, str(most))


def n_words(text) -> F.Column:
    """Number of words of a text column (null: 0), as long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# --------------------------------------------------------------------------- word arithmetic

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD1342543DE82EF95)
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 17, min(2 * len(self.up), 1 << 22))
            with np.errstate(over="ignore"):
                up, down = np.full(size, self.base), np.full(size, self.inv)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_ODD), _Powers(_MUL)


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(values: np.ndarray, powers: _Powers) -> np.ndarray:
    """``s`` with ``gram_hash(s, i, j)`` a polynomial hash of ``values[i:j]``."""
    up, _ = powers.to(len(values))
    s = np.empty(len(values) + 1, np.uint64)
    s[0] = 0
    np.cumsum(values * up[: len(values)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start, end, powers: _Powers) -> np.ndarray:
    """Hash of each range [start, end), equal for equal contents."""
    _, down = powers.to(len(s) - 1)
    return mix((s[end] - s[start]) * down[start] + np.asarray(end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, and where each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``most`` bytes."""
    data, off = texts(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and for each row the index of its first word (one more at the end)."""
    inside = _IS_WORD[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, about ``PART`` bytes at a time."""
    table, out, i = _TABLE_LOWER if lower else _TABLE, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PART, "right")))
        s = prefix_sums(table[data[a : ends[j - 1]]], _BYTES)
        out[i:j] = range_hash(s, starts[i:j] - a, ends[i:j] - a, _BYTES)
        i = j
    return out


#: Texts longer than this are cut, between words, into parts of about this many bytes before they are laid out in arrays.
PART = 1 << 20


def cuts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Parts of one text, each cut behind a white-space byte where there is one."""
    i = 0
    while len(data) - i > most:
        j = i + most
        while j < len(data):
            space = np.flatnonzero(_SPACE[data[j : j + most]])
            if len(space):
                j += int(space[0]) + 1
                break
            j += most
        yield data[i : min(j, len(data))]
        i = min(j, len(data))
    yield data[i:]


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of all runs of k consecutive word hashes, sorted."""
    s = prefix_sums(h, _WORDS)
    at = np.arange(len(h) - k + 1)
    return np.unique(range_hash(s, at, at + k, _WORDS))


def _merged(sets: list[np.ndarray]) -> np.ndarray:
    """The sorted union of sorted sets, which are given up."""
    h = np.concatenate(sets)
    sets.clear()
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _long_set(data: np.ndarray, k: int) -> np.ndarray:
    """The shingle set of one long text, part by part: it takes the memory of a part, and about four times the set's."""
    found, held, more = [], 0, np.zeros(0, np.uint64)
    for part in cuts(data, PART):
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        more = np.concatenate((more, word_hashes(part, starts, ends, lower=True)))
        if len(more) >= k:
            found.append(_windows(more, k))
            more = more[len(more) - k + 1 :]
            held += len(found[-1])
            if len(found) > 1 and held > 2 * len(found[0]):
                found = [_merged(found)]
                held = len(found[0])
    if found:
        return _merged(found) if len(found) > 1 else found[0]
    return _windows(more, len(more)) if len(more) else more


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles (lower-cased A-Z).

    With fewer than k words the whole sequence is one shingle; without words none.
    """
    if len(off) == 2 and len(data) > PART:
        yield _long_set(data, k)
        return
    starts, ends, first = word_spans(data, off)
    h = word_hashes(data, starts, ends, lower=True)
    s = prefix_sums(h, _WORDS)
    for a, b in zip(first[:-1], first[1:]):
        if b - a < k:
            yield range_hash(s, np.array([a]), np.array([b]), _WORDS) if b > a else h[:0]
        else:
            at = np.arange(a, b - k + 1)
            yield np.unique(range_hash(s, at, at + k, _WORDS))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(values) - w + 1
    low, span = values, 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[w - span : w - span + n])


# --------------------------------------------------------------------------- membership filter


class BitFilter:
    """A one-hash Bloom filter of fixed size (8 MB), whatever the number of keys.

    It may say yes to a key that was not put in, never no to one that was; as keys
    grow it lets more through, and what reads it stays right.  ``mixed`` keys are well
    mixed 64-bit values already and are used as they are.
    """

    WORDS = 1 << 20

    def __init__(self, keys: DataFrame, column: str, mixed: bool = False):
        self.mixed = mixed
        h = F.col(column) if mixed else F.xxhash64(F.col(column))
        rows = (
            keys.select(h.alias("h"))
            .groupBy(F.expr(f"h & {self.WORDS - 1}").cast("int").alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")).alias("bits"))
            .filter("at is not null")
            .toArrow()
        )
        bits = np.zeros(self.WORDS, np.uint64)
        bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        self.empty = not len(rows)
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self):
        return {"mixed": self.mixed, "shared": self.shared, "empty": self.empty}

    def test(self, h: np.ndarray) -> np.ndarray:
        """Of mixed keys, or of keys hashed by Spark's xxhash64 (as uint64)."""
        at = (h & np.uint64(self.WORDS - 1)).astype(np.int64)
        return ((self.shared.value[at] >> (h >> np.uint64(58))) & np.uint64(1)).astype(bool)

    def rows(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """Rows of ``df`` whose key may be in the filter; or, if not ``inside``, the others."""
        schema = df.schema

        def run(batches):
            for b in batches:
                h = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
                yield b.select(range(b.num_columns - 1)).filter(pa.array(self.test(h) == inside))

        return df.withColumn("__h", F.col(column) if self.mixed else F.xxhash64(F.col(column))).mapInArrow(run, schema)
