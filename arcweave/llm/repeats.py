"""Repeated windows of a corpus, found through minimiser anchors.

A window is k consecutive units (words or bytes) of one text.  Its anchor is the
least of its m-unit grams under a fixed hash order, so equal windows have anchors with
one gram at one offset.  Consecutive windows with one anchor form a run and travel as
one packed string.

1. Every anchor's gram is counted.  A gram that anchors one run only can't hold a
   repeated window.
2. Runs on repeated grams are written with their strings (one string a task for equal
   runs).  Very frequent grams rank behind all others, so that the many different
   contexts of a common passage do not meet in one bucket.
3. Runs are dealt out by gram.  Each bucket finds which windows occur twice.
4. The answers go back to the runs, and to the texts that hold them.

Both filters that pass 2 consults have a fixed size; a false yes ships a run in vain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _TABLE, _WORDS, BitFilter, Scratch, mix, pieces, prefix_sums, sliding_min, small_batches, word_hashes, word_spans

#: A gram that anchors more runs than this is ranked behind all others.
HOT = 512
#: Units looked at at once.
SEGMENT = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)
_TOP = np.uint64(1 << 63)
RUNS = "gram long, digest binary, rid binary, start int, n_windows int, content binary"


class Units:
    """Words or bytes of a chunk of texts."""

    def __init__(self, kind: str, data: np.ndarray, off: np.ndarray):
        self.kind, self.data = kind, data
        if kind == "words":
            self.starts, self.ends, self.first = word_spans(data, off)
        else:
            self.first = off

    def sums(self, a: int, b: int) -> tuple[np.ndarray, object]:
        """Prefix sums of the units [a, b) for gram hashes."""
        if self.kind == "words":
            if not hasattr(self, "hashes"):
                self.hashes = word_hashes(self.data, self.starts, self.ends)
            return prefix_sums(self.hashes[a:b], _WORDS), _WORDS
        return prefix_sums(_TABLE[self.data[a:b]], _BYTES), _BYTES

    def content(self, raw: bytes, a: int, b: int) -> bytes:
        """Units [a, b) as one string: bytes as they are, words joined by one space."""
        if self.kind == "words":
            return b" ".join(raw[self.starts[a] : self.ends[b - 1]].split())
        return raw[a:b]


def runs(units: Units, k: int, m: int, hot: BitFilter | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, end window, gram, moved) of the runs of all texts of a chunk.

    ``moved``: the gram is not the least one, since that is hot.
    """
    total, w = int(units.first[-1]), k - m + 1
    for at in range(0, max(0, total - k + 1), SEGMENT):
        end = min(total, at + SEGMENT + k - 1)
        s, powers = units.sums(at, end)
        _, down = powers.to(end - at)
        n = end - at - m + 1
        h = mix((s[m:] - s[:-m]) * down[:n])
        n_win = end - at - k + 1
        valid = np.ones(n_win, bool)
        lo, hi = np.searchsorted(units.first, (at, end))
        for b in units.first[lo:hi]:
            valid[max(0, b - at - k + 1) : max(0, b - at)] = False
        packed = ((h >> np.uint64(1)) & ~_PLACE) | np.arange(n, dtype=np.uint64)
        place = (sliding_min(packed, w) & _PLACE).astype(np.int64)
        least = place
        # Anchors are low in h, so their names are mixed once more: the filters want even bits.
        if hot is not None and hot.test(mix(h[np.unique(place[valid])])).any():
            packed[hot.test(mix(h))] |= _TOP
            place = (sliding_min(packed, w) & _PLACE).astype(np.int64)
        windows = np.flatnonzero(valid)
        if not len(windows):
            continue
        p, q = place[windows], least[windows]
        cut = np.flatnonzero((p[1:] != p[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
        a = np.concatenate(([0], cut))
        z = np.concatenate((cut, [len(windows)])) - 1
        moved = np.logical_or.reduceat(p != q, a)
        yield windows[a] + at, windows[z] + at + 1, mix(h[p[a]]), moved


def _count_grams(kind: str, k: int, m: int):
    def run(batches):
        for batch in batches:
            for _, _, data, off in pieces(batch.column("text")):
                for _, _, grams, _ in runs(Units(kind, data, off), k, m, None):
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    return run


def _ship_runs(kind: str, k: int, m: int, repeated: BitFilter, hot: BitFilter | None):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rid = batch.column("rid")
            for i, j, data, off in pieces(batch.column("text")):
                units, raw = Units(kind, data, off), data.tobytes()
                for first, end, grams, moved in runs(units, k, m, hot):
                    take = np.flatnonzero(repeated.test(grams) | moved)
                    if not len(take):
                        continue
                    first, end, grams = first[take], end[take], grams[take]
                    row = np.searchsorted(units.first, first, "right") - 1
                    digests, contents = [], []
                    for a, b in zip(first.tolist(), end.tolist()):
                        c = units.content(raw, a, b + k - 1)
                        d = hashlib.blake2b(c, digest_size=16).digest()
                        digests.append(d)
                        contents.append(None if d in seen else c)
                        seen.add(d)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)),
                            pa.array(digests, pa.binary()),
                            rid.take(pa.array(i + row)),
                            pa.array((first - units.first[row]).astype(np.int32)),
                            pa.array((end - first).astype(np.int32)),
                            pa.array(contents, pa.binary()),
                        ],
                        names=["gram", "digest", "rid", "start", "n_windows", "content"],
                    )
                    if len(seen) > 100_000:
                        seen.clear()

    return run


#: Bytes of packed strings of a block; a block ends with a gram.
BLOCK = 1 << 21


def _blocks(find: Callable[[list[bytes], int], list[np.ndarray]], k: int):
    """Runs sorted by gram and digest, block by block, to the flags of their windows."""

    def close(rows: list) -> pa.RecordBatch | None:
        # A digest's rows: its count once, its content once a task.
        contents: dict[bytes, bytes] = {}
        counts: dict[bytes, int] = {}
        for digest, n, content in rows:
            if content is not None:
                contents.setdefault(digest, content)
            if n is not None:
                counts[digest] = counts.get(digest, 0) + n
        keys = list(contents)
        out_d, out_f = [], []
        flags = find([contents[d] for d in keys], k) if keys else []
        for d, f in zip(keys, flags):
            if counts[d] > 1:
                f[:] = True
            if f.any():
                out_d.append(d)
                out_f.append(np.packbits(f).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_d, pa.binary()), pa.array(out_f, pa.binary())], names=["digest", "flags"]) if out_d else None

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                for gram, digest, n, content in zip(*(part.column(c).to_pylist() for c in ("gram", "digest", "n", "content"))):
                    if gram != last and size > BLOCK:
                        if out := close(rows):
                            yield out
                        rows, size = [], 0
                    last = gram
                    rows.append((digest, n, content))
                    size += len(content or b"")
        if out := close(rows):
            yield out

    return run


def row_id(id_col: str, text_col: str) -> F.Column:
    """128 bits that name a row by its id and text."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))), 16, "0") for seed in ("one", "two")]))


def repeated_windows(docs: DataFrame, kind: str, k: int, m: int, find: Callable, scratch: Scratch) -> DataFrame:
    """Which windows of each text occur at another place.

    ``docs``: rid (a key of the text), text.  ``find(contents, k)`` gets distinct
    packed strings and returns for each the flags of its windows that occur twice
    among them.  Returns rid and ``hits``, an array of (start, n_windows, flags); texts
    without a repeated window have no row.
    """
    small_batches(docs.sparkSession)
    grams = docs.mapInArrow(_count_grams(kind, k, m), "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    grams = scratch.keep(grams, "grams")
    repeated = BitFilter(grams, "gram", mixed=True)
    hot = BitFilter(grams.filter(F.col("n") > HOT), "gram", mixed=True)
    shipped = scratch.keep(docs.mapInArrow(_ship_runs(kind, k, m, repeated, None if hot.empty else hot), RUNS), "runs")
    scratch.drop(grams)
    counts = shipped.groupBy("gram", "digest").agg(F.count("*").alias("n")).withColumn("content", F.lit(None).cast("binary"))
    strings = shipped.filter("content is not null").select("gram", "digest", F.lit(None).cast("long").alias("n"), "content")
    dealt = counts.unionByName(strings).repartition(F.col("gram")).sortWithinPartitions("gram", "digest")
    found = scratch.keep(dealt.mapInArrow(_blocks(find, k), "digest binary, flags binary"), "found")
    hits = shipped.select("digest", "rid", "start", "n_windows").join(found, "digest")
    return hits.groupBy("rid").agg(F.collect_list(F.struct("start", "n_windows", "flags")).alias("hits"))


def covered(n: int, hits: list[dict] | None, k: int) -> np.ndarray:
    """Which of n units lie in a flagged window."""
    gone = np.zeros(n, bool)
    starts = [hit["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(hit["flags"], np.uint8), count=hit["n_windows"])) for hit in hits or ()]
    at = np.unique(np.concatenate(starts)) if starts else gone[:0]
    if len(at):
        # Windows that touch are one span.
        cut = np.flatnonzero(np.diff(at) > k) + 1
        for a, z in zip(at[np.concatenate(([0], cut))].tolist(), at[np.concatenate((cut - 1, [len(at) - 1]))].tolist()):
            gone[a : z + k] = True
    return gone


def apply_hits(docs: DataFrame, hits: DataFrame, cut: Callable[[list[bytes], list], list[pa.Array]], fields: str, scratch: Scratch) -> DataFrame:
    """``cut(texts, hits)`` over all rows: ``docs`` has rid, text and other columns, which stay (but rid and text).

    Only texts that may have hits are shuffled; a fixed-size filter tells.
    """
    hits = scratch.keep(hits, "hits")
    here = BitFilter(hits, "rid")
    others = [c for c in docs.columns if c not in ("rid", "text")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), fields])

    def run(clean: bool):
        def cut_all(batches):
            for b in batches:
                if clean:
                    b = b.filter(pa.array(~here.test(b.column("h").to_numpy().view(np.uint64))))
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    found = [None] * part.num_rows if clean else part.column("hits").to_pylist()
                    texts = [x.encode() if x is not None else b"" for x in part.column("text").to_pylist()]
                    new = cut(texts, found)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *new], schema=pa.schema([*(part.schema.field(c) for c in others), *(pa.field(f.split()[0], a.type) for f, a in zip(fields.split(", "), new))]))

        return cut_all

    touched = here.rows(docs, "rid").join(hits, "rid", "left").mapInArrow(run(False), schema)
    untouched = docs.withColumn("h", F.xxhash64("rid")).drop("rid").mapInArrow(run(True), schema)
    return touched.unionByName(untouched)
