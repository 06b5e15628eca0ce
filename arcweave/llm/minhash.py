"""Near-duplicate documents: MinHash bands, verified links, connected components.

1. Documents with one shingle set are folded into a class, named by its least id and
   the digest of the set.  Every class has a signature, the minima of many universal
   hash functions; classes whose minima agree on a whole band meet in a bucket.
2. Every class is compared with one pivot, the one it meets in most buckets: a signature
   test, then the full sets.  Connected components of these links come from alternating
   large-star and small-star steps.
3. Buckets with members of several components are open.  Components that meet in open
   buckets are gathered in units around the largest one they meet; the classes of a unit
   are packed into blocks of bounded size, and blocks of one unit, or of two that meet,
   are compared set by set inside one task.  Only the links that join components come
   out.  All members of open buckets are thus compared: nothing is capped.

The work of step 2 is linear in the members of buckets.  That of step 3 is spread over
pairs of blocks; rows moved grow with blocks, not with pairs of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_table
from .common import BitFilter, Scratch, mix, pieces, shingle_sets, small_batches

#: 40 bands of 5 minima: a pair at similarity 0.8 shares none with probability (1 - 0.8**5)**40 = 1.2e-7.
BANDS, ROWS = 40, 5
N_HASH = BANDS * ROWS
#: A pair whose estimate from N_HASH minima is this far below the threshold is dropped (5 standard deviations).
SLACK = 0.14
#: Most classes of a block, and most bytes of their sets (8 a shingle) but for one class alone; classes that a block holds on average.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_MEAN = 256, 2 << 20, 128

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 2**31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, N_HASH, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)

#: Name of a class: ordered by its least doc_id, unique even where ids are not.
CLASS = "struct<id: bigint, d1: bigint, d2: bigint>"


# --------------------------------------------------------------------------- signatures


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (a * x + b modulo 2**32) over a set of mixed 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(N_HASH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = x[i : i + 2048, None] * _A
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; ``sig`` is (classes, N_HASH)."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND).sum(axis=2, dtype=np.uint64) + _SALT)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        sums = np.array([shingles.sum(dtype=np.uint64), (shingles * (shingles >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)])
    one, two = mix(sums).view(np.int64)
    return int(one), int(two)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, off in pieces(batch.column("text")):
                sig = np.zeros((j - i, N_HASH), np.uint16)
                n, names = np.zeros(j - i, np.int64), np.zeros((j - i, 2), np.int64)
                for r, s in enumerate(shingle_sets(data, off, k)):
                    n[r], names[r] = len(s), digest(s)
                    if len(s):
                        sig[r] = minima(s).astype(np.uint16)
                columns = [ids.slice(i, j - i), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "sig"])

    return run


def _sets(k: int, wanted: BitFilter):
    """Texts of wanted ids (column h: their hash) to (doc_id, d1, d2, n, set): the sorted 64-bit shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.test(batch.column("h").to_numpy().view(np.uint64))))
            ids = batch.column("doc_id")
            for i, j, data, off in pieces(batch.column("text")):
                sets = list(shingle_sets(data, off, k))
                names = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
                columns = [ids.slice(i, j - i), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d1", "d2", "n", "set"])

    return run


def _keys(shared: BitFilter | None):
    """(c, n, key) of every class and band, or of those whose key may be in ``shared``."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                keys = band_keys(_matrix(part.column("sig"))).ravel()
                at = np.arange(len(keys)) if shared is None else np.flatnonzero(shared.test(keys))
                rows = part.select(["c", "n"]).take(pa.array(at // BANDS))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys[at].view(np.int64))], names=["c", "n", "key"])

    return run


def _bare_keys(batches):
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(_matrix(b.column("sig").slice(i, 2048))).ravel().view(np.int64))], names=["key"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, N_HASH)


# --------------------------------------------------------------------------- pairs with a pivot


def _estimate(least: float):
    """Keeps the pairs whose signatures agree on at least that share; drops the signatures."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                if part.num_rows:
                    near = (_matrix(part.column("sig_a")) == _matrix(part.column("sig_b"))).mean(axis=1) >= least
                    yield part.select(["a", "b"]).filter(pa.array(near))

    return run


def _confirm(percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for b in batches:
            hit = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(b.column("set_a"), b.column("set_b"))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(hit))

    return run


# --------------------------------------------------------------------------- blocks


@dataclass
class Block:
    """Classes (ids and digests), the names of their components, and their sets one after another."""

    c: np.ndarray
    comp: np.ndarray
    size: np.ndarray
    sets: np.ndarray

    def pack(self) -> bytes:
        raw = b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array([len(self.c)]), self.c, self.comp, self.size, self.sets))
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.int64)
        m = int(raw[0])
        return cls(raw[1 : 1 + 3 * m].reshape(m, 3), raw[1 + 3 * m : 1 + 6 * m].reshape(m, 3), raw[1 + 6 * m : 1 + 7 * m], raw[1 + 7 * m :].view(np.uint64))


def _names(column: pa.Array) -> np.ndarray:
    """(rows, 3) numbers of a struct column of class names."""
    return np.stack([np.asarray(x) for x in column.flatten()], axis=1).astype(np.int64)


def _name_column(names: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(names[:, i])) for i in range(3)], names=["id", "d1", "d2"])


def _pack(batches):
    """Sorted rows (unit, core, slot, c, comp, n, set) to blocks (unit, core, block, payload).

    A block holds consecutive classes of one slot of a unit, core or not, and is named by
    its first class.
    """
    open_, held, at = [], 0, None

    def close():
        block = Block(*(np.concatenate([x[i] for x in open_]) for i in range(4)))
        columns = [_name_column(np.array([at[:3]])), pa.array([bool(at[3])]), _name_column(block.c[:1]), pa.array([block.pack()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "core", "block", "payload"])

    for b in batches:
        if not b.num_rows:
            continue
        unit, c, comp = (_names(b.column(x)) for x in ("unit", "c", "comp"))
        core, slot = (b.column(x).to_numpy(zero_copy_only=False) for x in ("core", "slot"))
        for r, s in enumerate(b.column("set")):
            here, s = (*unit[r].tolist(), bool(core[r]), int(slot[r])), np.frombuffer(s.as_buffer(), np.uint64)
            if open_ and (here != at or len(open_) == BLOCK_ROWS or held + 8 * len(s) > BLOCK_BYTES):
                yield close()
                open_, held = [], 0
            at, held = here, held + 8 * len(s)
            open_.append((c[r : r + 1], comp[r : r + 1], np.array([len(s)]), s.copy()))
    if open_:
        yield close()


def shared_counts(x: np.ndarray, x_off: np.ndarray, y: np.ndarray, y_off: np.ndarray) -> np.ndarray:
    """Intersection sizes of every set of x with every set of y.

    Hashes that many sets on both sides hold are multiplied as 0/1 matrices, some
    thousand at a time; rare ones are paired one by one.
    """
    mx, my = len(x_off) - 1, len(y_off) - 1
    both = np.zeros((mx, my), np.float64)
    common = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    if not len(common):
        return both

    def entries(h, off):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        inside = common[at] == h
        return np.repeat(np.arange(len(off) - 1), np.diff(off))[inside], at[inside]

    (xr, xc), (yr, yc) = entries(x, x_off), entries(y, y_off)
    nx, ny = np.bincount(xc, minlength=len(common)), np.bincount(yc, minlength=len(common))
    dense = nx * ny >= max(64, mx * my // 256)
    number = np.cumsum(dense) - 1
    width = 4096
    for lo in range(0, int(dense.sum()), width):
        def table(r, c, m):
            take = dense[c]
            r, c = r[take], number[c[take]] - lo
            ok = (c >= 0) & (c < width)
            t = np.zeros((m, min(width, int(dense.sum()) - lo)), np.float32)
            t[r[ok], c[ok]] = 1
            return t

        both += table(xr, xc, mx) @ table(yr, yc, my).T
    rare = ~dense[xc]
    if rare.any():
        order = np.argsort(yc, kind="stable")
        first = np.concatenate(([0], np.cumsum(ny)))
        xr, xc = xr[rare], xc[rare]
        step = max(1, (1 << 21) // max(1, int(ny[xc].max())))
        for i in range(0, len(xr), step):
            r, c = xr[i : i + step], xc[i : i + step]
            times = ny[c]
            inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            other = yr[order[np.repeat(first[c], times) + inner]]
            both += np.bincount(np.repeat(r, times) * my + other, minlength=mx * my).reshape(mx, my)
    return both


def block_links(x: Block, y: Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names (a, b) of linked classes of two blocks that join components, no more than needed to join them."""
    none = np.zeros((0, 3), np.int64)
    _, label = np.unique(np.concatenate((x.comp, y.comp)), axis=0, return_inverse=True)
    label = label.ravel()
    lx, ly = label[: len(x.c)], label[len(x.c) :]
    if (label == label[0]).all():
        return none, none
    offs = [np.concatenate(([0], np.cumsum(b.size))) for b in (x, y)]
    both = shared_counts(x.sets, offs[0], y.sets, offs[1])
    hit = (both > 0) & (100 * both >= percent * (x.size[:, None] + y.size[None, :] - both)) & (lx[:, None] != ly[None, :])
    i, j = np.nonzero(hit)
    if not len(i):
        return none, none
    u, v = np.minimum(lx[i], ly[j]), np.maximum(lx[i], ly[j])
    _, first = np.unique(u * (len(label) + 1) + v, return_index=True)
    root = list(range(int(label.max()) + 1))

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    take = []
    for t in first.tolist():
        p, q = find(int(u[t])), find(int(v[t]))
        if p != q:
            root[max(p, q)] = min(p, q)
            take.append(t)
    return x.c[i[take]], y.c[j[take]]


def _compare(percent: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x, y = (Block.unpack(b.column(c)[r].as_py()) for c in ("payload_a", "payload_b"))
                a, z = block_links(x, y, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([_name_column(a), _name_column(z)], names=["a", "b"])

    return run


def _open_links(met: DataFrame, stars: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links between components that meet in a bucket (None where no bucket has several)."""
    known = met.join(stars.toDF("c", "comp"), "c", "left").select("key", "c", F.coalesce("comp", "c").alias("comp"))
    known = scratch.keep(known, "known")
    several = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    known, closed = scratch.keep(known.join(several, "key"), "open"), known
    scratch.drop(closed)
    if known.isEmpty():
        return None
    members = scratch.keep(known.groupBy("c").agg(F.min("comp").alias("comp")), "members")
    sizes = scratch.keep(members.groupBy("comp").agg(F.count("*").alias("of")), "sizes")
    # The largest component that a component meets is its unit.
    kinds = known.select("key", "comp").distinct().join(sizes, "comp")
    largest = kinds.groupBy("key").agg(F.max(F.struct("of", "comp")).alias("largest"))
    units = kinds.join(largest, "key").groupBy("comp").agg(F.max("largest")["comp"].alias("unit"))
    units = scratch.keep(units, "units")
    present = kinds.join(units, "comp").select("key", "unit").distinct()
    meet = present.toDF("key", "u").join(present.toDF("key", "v"), "key").filter("u <= v").select("u", "v").distinct()
    meet = scratch.keep(meet, "meet")
    rows = members.join(units, "comp").join(sets.select("c", "n", "set"), "c")
    core = (F.col("comp") == F.col("unit")).alias("core")
    # Units of many classes go into slots by hash, so that blocks are as full, and pairs of blocks as few, whatever the partitioning.
    wide = units.join(sizes, "comp").groupBy(F.col("unit").alias("w"), core.alias("w_core")).agg(F.sum("of").alias("of")).filter(F.col("of") > BLOCK_MEAN)
    rows = rows.select("unit", core, "c", "comp", "n", "set").join(F.broadcast(wide), (F.col("unit") == F.col("w")) & (F.col("core") == F.col("w_core")), "left")
    slot = F.coalesce(F.pmod(F.xxhash64("c"), F.ceil(F.col("of") / BLOCK_MEAN)), F.lit(0)).cast("long").alias("slot")
    rows = scratch.keep(rows.select("unit", "core", slot, "c", "comp", "n", "set"), "rows")
    blocks = rows.repartition("unit", "core", "slot").sortWithinPartitions("unit", "core", "slot", "c").mapInArrow(_pack, f"unit {CLASS}, core boolean, block {CLASS}, payload binary")
    blocks = scratch.keep(blocks, "blocks")
    scratch.drop(known, rows)
    at = blocks.select("unit", "core", "block")
    pairs = meet.join(at.toDF("u", "core_a", "a"), "u").join(at.toDF("v", "core_b", "b"), "v")
    pairs = pairs.filter("u <> v or a <= b and not (core_a and core_b)").select("a", "b")
    load = blocks.select("block", "payload")
    pairs = pairs.join(load.toDF("a", "payload_a"), "a").join(load.toDF("b", "payload_b"), "b")
    return scratch.keep(pairs.select("payload_a", "payload_b").mapInArrow(_compare(percent), f"a {CLASS}, b {CLASS}"), "links")


# --------------------------------------------------------------------------- whole operator


def _named_rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, n, d1, d2, component) of every row; component: name of the least class reachable, null without a class."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.keep(docs.mapInArrow(_signatures(k), "doc_id long, n long, d1 long, d2 long, sig binary"), "signatures")
    # Classes of equal sets; partial sums on the map side make one row a task of any group of copies.
    least = rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("m"))
    classes = least.select(F.expr("named_struct('id', m.doc_id, 'd1', d1, 'd2', d2)").alias("c"), "m.n", "m.sig")
    classes = scratch.keep(classes, "classes")
    # Buckets that more than one class falls into.
    keys = classes.mapInArrow(_bare_keys, "key long").groupBy("key").agg(F.count("*").alias("of")).filter("of > 1").select("key")
    members = scratch.keep(classes.mapInArrow(_keys(BitFilter(keys, "key", mixed=True)), f"c {CLASS}, n long, key long"), "members")
    scratch.release()
    pivots = members.groupBy("key").agg(F.count("*").alias("of"), F.min(F.struct(F.xxhash64("c").alias("turn"), "c", "n")).alias("p")).filter("of > 1")
    met = scratch.keep(members.join(pivots, "key").select("key", "c", "n", F.col("p.c").alias("p"), F.col("p.n").alias("n2")), "met")
    scratch.drop(members)
    some = met.select("c").distinct()
    filt = BitFilter(some.select(F.col("c.id").alias("id")), "id")
    # The pivot that a class meets most often.
    pairs = met.filter(f"c <> p and 100 * least(n, n2) >= {percent} * greatest(n, n2)").groupBy("c", "p").agg(F.count("*").alias("times"))
    pairs = pairs.groupBy("c").agg(F.max(F.struct("times", "p"))["p"].alias("p")).toDF("a", "b")
    sigs = filt.rows(classes.select("c", "sig", F.col("c.id").alias("id")), "id").select("c", "sig")
    near = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").mapInArrow(_estimate(percent / 100 - SLACK), f"a {CLASS}, b {CLASS}")
    near = scratch.keep(near, "near")
    sets = docs.filter("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInArrow(_sets(k, filt), "doc_id long, d1 long, d2 long, n long, set binary")
    sets = sets.select(F.expr("named_struct('id', doc_id, 'd1', d1, 'd2', d2)").alias("c"), "n", "set").join(some, "c", "left_semi").dropDuplicates(["c"])
    sets = scratch.keep(sets, "sets")
    scratch.drop(classes)
    load = sets.select("c", "set")
    links = near.join(load.toDF("a", "set_a"), "a").join(load.toDF("b", "set_b"), "b").mapInArrow(_confirm(percent), f"a {CLASS}, b {CLASS}")
    stars = star_table(scratch.keep(links, "links"), scratch)
    scratch.release()
    more = _open_links(met, stars, sets, percent, scratch)
    scratch.drop(met, sets)
    if more is not None and not more.isEmpty():
        stars = star_table(stars.unionByName(more), scratch)
    scratch.release()
    names = rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    names = names.select("d1", "d2", F.struct("id", "d1", "d2").alias("c")).join(stars.toDF("c", "component"), "c", "left")
    # Written, so that the join below has one plain exchange a side, whose hot keys (large groups of copies) can be split.
    names = scratch.keep(names.select("d1", "d2", F.coalesce("component", "c").alias("component")), "components")
    return rows.select("doc_id", "n", "d1", "d2").join(names, ["d1", "d2"], "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under near-duplicate links.

    A document's set is that of its distinct k-word shingles, A-Z lower-cased; with
    fewer words the whole sequence is one shingle; a null text, or one without words,
    has none and is linked with nothing.  Two documents are linked if
    100 * |intersection| >= percent * |union|.  Ids are expected to be unique; rows
    with one id are each judged by their own text, and equal rows stay as many.  A row
    with a null id links nothing; its component is that of the others with its set, or
    null.  Long texts are read in parts; their sets (8 bytes a shingle) are held whole.
    An empty table gives an empty result.  Other columns, whatever their names, are not
    read.  Returns doc_id, n_shingles, component_id (least id reachable, itself
    included), kept (doc_id = component_id, true for a null id).
    """
    rows = _named_rows(docs, k, percent, id_col, text_col, Scratch(docs.sparkSession, "minhash"))
    found = F.when(F.col("n") > 0, F.coalesce(F.col("component.id"), F.col("doc_id"))).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def _digests(k: int, wanted: BitFilter):
    """Rows (row, id, text, h) of wanted ids to (row, id, d1, d2), the digest of the text's set."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(wanted.test(b.column("h").to_numpy().view(np.uint64))))
            for i, j, data, off in pieces(b.column("text")):
                names = np.array([digest(s) for s in shingle_sets(data, off, k)], np.int64).reshape(-1, 2)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(names[:, 0]), pa.array(names[:, 1])], names=["row", "id", "d1", "d2"])

    return run


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, that with the least id, and all others; columns of ``docs`` stay.

    Of rows with one id and one set one stays; rows with one id and different texts are
    each judged by their own text.  All rows with a null id, or without words, stay.
    An empty table stays empty; columns may have any names.  Only rows that may go are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "without")
    rows = _named_rows(docs, k, percent, id_col, text_col, scratch).filter("doc_id is not null and n > 0")
    stays = F.col("component").isNull() | (F.struct(F.col("doc_id").alias("id"), "d1", "d2") == F.col("component"))
    found = rows.withColumn("stays", stays).groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("times"), F.first("stays").alias("stays")).filter("times > 1 or not stays")
    found = scratch.keep(found.select(F.col("doc_id").alias("g"), F.col("d1").alias("g1"), F.col("d2").alias("g2"), "stays"), "going")
    touched = BitFilter(found, "g")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = packed.drop("text").withColumn("d1", F.lit(0).cast("long")).withColumn("d2", F.lit(0).cast("long")).schema
    maybe = packed.withColumn("h", F.xxhash64("id")).mapInArrow(_digests(k, touched), schema)
    maybe = maybe.join(found, (F.col("id") == F.col("g")) & (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")), "left")
    stay = maybe.filter("g is null").select("row")
    one = maybe.filter("g is not null and stays").dropDuplicates(["id", "d1", "d2"]).select("row")
    rest = touched.rows(packed.select("row", "id"), "id", inside=False).select("row")
    return rest.unionByName(stay).unionByName(one).select("row.*")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
