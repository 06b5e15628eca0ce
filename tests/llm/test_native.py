"""op1, op6, op7, op9, op10 against plain forms; odd inputs."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest

from arcweave.llm import fingerprint, media, mixing, packing, sharding


def check_best_fit(sizes, sources, clusters, cap):
    """Every item lands in the tightest bin that may take it."""
    left, held = {}, defaultdict(set)
    for b, s, so, c in zip(packing.best_fit(sizes, sources, clusters, cap), sizes, sources, clusters):
        keys = {("s", so)} - {("s", None)} | {("c", c)} - {("c", None)}
        fits = [r for x, r in left.items() if r >= s and not held[x] & keys]
        assert left.get(b, cap) == (min(fits) if fits else cap) and not held[b] & keys
        assert b in left or not fits
        left[b] = left.get(b, cap) - s
        held[b] |= keys


def test_best_fit():
    for seed in range(60):
        r = random.Random(seed)
        n, cap = r.choice([0, 1, 5, 60, 200]), r.choice([10, 50])
        check_best_fit(
            sorted((r.randint(1, cap) for _ in range(n)), reverse=True),
            [None if r.random() < 0.1 else "h" if r.random() < 0.35 else r.randint(0, 6) for _ in range(n)],
            [None if r.random() < 0.1 else "d" if r.random() < 0.3 else r.randint(0, n) for _ in range(n)],
            cap,
        )


def test_pack_documents(frame, corpus, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    docs = frame([*corpus, (None, "a b c")]).withColumn("bin", packing.F.lit("clash"))
    docs = docs.unionByName(docs.filter(f"doc_id = {corpus[0][0]}"))
    rows = packing.pack_documents(docs, capacity=100).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {i: (t or "") for i, t in corpus} | {None: "a b c"}
    words, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        words[r["doc_id"]] += r["size"]
        if r["bin"] is None:
            assert r["size"] == 0
        else:
            bins[r["bin"]].append(r)
    assert words == {i: len(t.encode().split()) * (2 if i == corpus[0][0] else 1) for i, t in text.items()}
    for members in bins.values():
        members.sort(key=lambda r: r["bin_offset"])
        assert sum(r["size"] for r in members) == members[0]["bin_fill"] <= 100
        assert [r["bin_offset"] for r in members] == list(np.cumsum([0] + [r["size"] for r in members[:-1]]))
        s = [source[r["doc_id"]] for r in members if source[r["doc_id"]] is not None]
        t = [re.sub(r"\s+", " ", text[r["doc_id"]]).strip().lower() for r in members]
        assert len(set(s)) == len(s) and len(set(t)) == len(t)
    assert packing.pack_documents(frame([])).count() == 0


def test_media_round_trip():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 40):
        p = r.integers(0, 256, media.FRAME * n, dtype=np.uint8).tobytes()
        frames, fps = media.read_avi(media.encode_avi(p))
        assert frames.tobytes() == p and fps == media.FPS
    # The full decoder sees the same: every sample is a flat block of 64.
    picture = media.encode_frames(np.frombuffer(p, np.uint8).reshape(-1, media.FRAME))[0].tobytes()
    whole = np.frombuffer(p[: media.FRAME], np.uint8).reshape(media.BLOCKS_Y, media.BLOCKS_X).repeat(8, axis=0).repeat(8, axis=1)
    assert (media.decode_picture(picture)[:, :, 0] == whole).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")


def test_shots():
    dark, light = np.full((10, media.FRAME), 20, np.uint8), np.full((10, media.FRAME), 220, np.uint8)
    assert media.shot_starts(np.concatenate((dark, light, dark))).tolist() == [0, 10, 20]
    assert media.shot_starts(dark).tolist() == [0]


def test_media_digests(frame, corpus):
    docs = frame([*corpus, (None, "x")])
    for r in media.media_digests(docs).collect():
        text = (dict(corpus).get(r["doc_id"]) if r["doc_id"] is not None else "x") or ""
        raw = text.encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    clips = media.clips(media.store_media(docs)).collect()
    assert {c["doc_id"] for c in clips} == {*dict(corpus), None} and all(c["end_s"] > c["start_s"] for c in clips)
    assert media.media_digests(frame([])).count() == 0


def fill(sizes, weights, total, cap):
    """Water-filling round by round."""
    target, open_ = {}, list(sizes)
    while open_:
        level = total / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] >= cap * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def test_mixing(frame, corpus):
    docs = frame([*corpus, corpus[0]]).withColumn("taken", mixing.F.lit("clash"))
    rows = mixing.mix_sources(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t in corpus}
    by, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    order = sorted((s for s in by if s is not None)) + [None]
    expected = fill(by, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(by.values()), 2)
    for r in rows:
        assert abs(r["target"] - expected[r["source"]]) < 1e-6 and r["source_size"] == by[r["source"]]
    assert all(abs(taken[s] - expected[s]) < 1 for s in by)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].encode().split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_sources(frame([])).count() == 0 and mixing.mix_sources(frame([(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("share, cap", [(1.5, 2.0), (0.4, 1.0), (1.0, 1.25)])
def test_targets_of_many_sources(spark, share, cap):
    from arcweave.llm.common import Scratch

    r = random.Random(str((share, cap)))
    sizes = {f"s{r.randrange(10**6)}é": r.choice([0, 1, 10, 500, r.randint(1, 10**6)]) for _ in range(60)} | {None: 77}
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, share * sum(sizes.values()), cap)
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), share, cap, Scratch(spark, "t")).collect()
    assert {x["source"] for x in rows} == set(sizes) and all(abs(x["target"] - expected[x["source"]]) < 1e-6 for x in rows)


def test_mixing_all_capped(frame):
    rows = mixing.mix_sources(frame([(i, "a b c") for i in range(9)]), share=5.0).collect()
    assert all(r["taken"] == 6 for r in rows)


def test_fingerprints(frame, corpus):
    extra = [(900, "Straße  ﬁn"), (901, "straße fin"), (902, "é"), (903, "É"), (904, "abcd")]
    rows = [*corpus, *extra]
    docs = frame(rows)
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    canon = lambda t: re.sub(r"\s+", " ", nfkc(nfkc(t or "").casefold())).strip()
    order = [t or "" for _, t in rows]
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", order[(k + 1) % len(order)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(canon(edited) == canon(t)) and r["near_next"] == float(canon(nxt) == canon(t))
    same, print_of = defaultdict(set), defaultdict(set)
    for i, t in rows:
        same[canon(t)].add(got[i]["fingerprint"])
        print_of[got[i]["fingerprint"]].add(canon(t))
    assert all(len(x) == 1 for x in same.values()) and all(len(x) == 1 for x in print_of.values())
    again = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(docs.withColumn("fingerprint", fingerprint.F.lit(1))).collect()}
    assert again == {i: r["fingerprint"] for i, r in got.items()}
    assert fingerprint.edited_fingerprints(frame([])).count() == 0
    one = fingerprint.edited_fingerprints(frame([(1, "a"), (1, "a"), (None, None)])).collect()
    assert len(one) == 3
    # Equal rows follow each other; a null id comes first, behind the last.
    assert sorted((r["doc_id"] or 0, r["near_next"]) for r in one) == [(0, 0.0), (1, 0.0), (1, 1.0)]
    words = fingerprint.edited_fingerprints(docs.sparkSession.createDataFrame([("b", "wxyz"), ("a", "abcd"), ("c", "1234")], "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in words} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in (("a", "abcw"), ("b", "wxy1"), ("c", "123a"))}


def test_fingerprint_collisions(frame, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda t: fingerprint.F.lit("same"))
    got = [r["fingerprint"] for r in fingerprint.fingerprint_documents(frame([(1, "b"), (2, "a"), (3, "b")])).orderBy("doc_id").collect()]
    assert got == ["same-2", "same-1", "same-2"]
    assert fingerprint.edited_fingerprints(frame([(1, "b"), (2, "a"), (3, "b")])).count() == 3


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    before = None
    for n in range(1, 20):
        now = sharding.jump_hash(keys, n)
        assert now.min() >= 0 and now.max() == n - 1
        if before is not None:
            moved = now != before
            assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = now


def test_shards(frame, corpus):
    docs = frame([*corpus, corpus[0], (None, "x")]).withColumn("shard", sharding.F.lit("clash"))
    rows = sharding.shard_documents(docs).collect()
    text, slots = dict(corpus) | {None: "x"}, defaultdict(list)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(frame([])).count() == 0
