"""op2, op4 and op5 against brute force; their parts against plain forms."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm import common, minhash, repeats, suffix, superkmer
from arcweave.operators.components import star_table


def brute_near(rows, k):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(frame, corpus, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(corpus), k).collect()}
    assert got == brute_near(corpus, k)


def test_large_bucket_of_unlike_members(frame, monkeypatch):
    """Many texts that share a passage without being near-duplicates, and a chain among them, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    r = random.Random(1)
    word = lambda: "w%d" % r.randrange(10**6)
    common_part = [word() for _ in range(40)]
    rows = [(i, " ".join(common_part + [word() for _ in range(14)])) for i in range(25)]
    chain = common_part + [word() for _ in range(10)]
    for i in range(25, 31):
        rows.append((i, " ".join(chain)))
        chain = [*chain[:-4], *[word() for _ in range(4)]] if i % 2 else [*chain[4:], *[word() for _ in range(4)]]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(frame(rows), 2).collect()}
    assert got == brute_near(rows, 2)


def test_large_near_group_and_common_word_pair(frame):
    """Many edits of one text, most of them too far from each other, and one word pair in every text."""
    r = random.Random(2)
    word = lambda: "w%d" % r.randrange(10**6)
    base = [word() for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(60), r.choice([1, 1, 2, 4, 5])):
            w[at] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, "the common " + " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(150, 250)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(frame(rows), 2).collect()}
    assert got == brute_near(rows, 2)


def test_null_ids_repeated_ids_clashing_names(spark):
    """Each row is judged by its own text; a null id links nothing; other columns may have any name."""
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text.replace("w7 ", "x "), " ".join(f"v{i}" for i in range(40))
    rows = [(5, text), (7, near), (7, other), (9, other), (None, text), (None, near + " y"), (3, ""), (4, None), (9, other)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, c long, d1 long, component string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (7, 5, False), (7, 7, True), (9, 7, False), (9, 7, False), (None, 5, True), (None, None, True), (3, 3, True), (4, 4, True)], key=str)
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(5, text), (7, other), (None, text), (None, near + " y"), (3, ""), (4, None)], key=str)


def test_shared_counts_and_blocks():
    """Dense and rare hashes against plain sets; a block and its packed form."""
    r = np.random.default_rng(5)
    for _ in range(20):
        sides = [[np.unique(r.integers(0, r.choice([20, 400]), r.integers(0, 60)).astype(np.uint64)) for _ in range(r.integers(1, 40))] for _ in range(2)]
        (x, xo), (y, yo) = ((np.concatenate(s), np.concatenate(([0], np.cumsum([len(z) for z in s])))) for s in sides)
        assert (minhash.shared_counts(x, xo, y, yo) == [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]).all()
    b = minhash.Block(np.arange(6).reshape(2, 3), np.arange(6, 12).reshape(2, 3), np.array([1, 2]), np.array([1, 2, 2**63], np.uint64))
    again = minhash.Block.unpack(b.pack())
    assert all((getattr(b, f) == getattr(again, f)).all() for f in ("c", "comp", "size", "sets"))


def test_long_text_has_the_same_shingles(monkeypatch):
    t = np.frombuffer((" \n".join(f"Word{i % 700}" for i in range(3000)) + " " + "z" * 900).encode(), np.uint8)
    off = np.array([0, len(t)])
    whole = next(common.shingle_sets(t, off, 5))
    for part in (50, 333, 4096):
        monkeypatch.setattr(common, "PART", part)
        assert (next(common.shingle_sets(t, off, 5)) == whole).all()


def test_without_near_duplicates(frame, corpus):
    docs = frame([*corpus, corpus[0]])
    kept = sorted(r["doc_id"] for r in minhash.without_near_duplicates(docs).collect())
    assert kept == sorted(i for i, x in brute_near(corpus, 5).items() if x[2])
    assert minhash.without_near_duplicates(docs).columns == docs.columns


def test_star_table(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    from arcweave.llm.common import Scratch

    got = {r["a"]: r["b"] for r in star_table(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 140)}}


def brute_words(rows, k=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    c = Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if c[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_substring_dedup(frame, corpus, monkeypatch):
    for hot in (512, 3):
        monkeypatch.setattr(repeats, "HOT", hot)
        out = superkmer.substring_dedup(frame(corpus).withColumn("rid", common.F.lit("clash"))).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute_words(corpus)
        for r in out:
            assert hashlib.sha256(b" ".join(r["kept_text"].encode().split())).hexdigest() == r["kept_sha256"] and r["rid"] == "clash"


def test_long_texts_in_parts(corpus, monkeypatch):
    """The same cuts where texts are laid out and split in small parts."""
    texts = [(t or "").encode() for _, t in corpus]
    hits = [[{"start": 2, "n_windows": 9, "flags": np.packbits([1, 0, 0, 1, 0, 0, 0, 0, 1]).tobytes()}] if len(t.split()) > 60 else None for t in texts]
    whole = [c.to_pylist() for c in superkmer._cut(35, True)(texts, hits)]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    hashes = common.word_hashes(data, starts, ends)
    for part in (40, 1000):
        monkeypatch.setattr(superkmer, "PART", part)
        monkeypatch.setattr(common, "PART", part)
        assert [c.to_pylist() for c in superkmer._cut(35, True)(texts, hits)] == whole
        assert (common.word_hashes(data, starts, ends) == hashes).all()


def brute_bytes(rows, k=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(t[j : j + k] for _, t in texts for j in range(len(t) - k + 1))
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - k + 1):
            if c[t[j : j + k]] > 1:
                gone[j : j + k] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup(frame, corpus, monkeypatch):
    expected = brute_bytes(corpus)
    for bucket, segment in ((1 << 18, 1 << 21), (64, 500)):
        monkeypatch.setattr(suffix, "BUCKET", bucket)
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.suffix_dedup(frame(corpus)).collect()}
        assert got == expected


def test_suffix_blocks():
    r = random.Random(2)
    for alpha in (b"ab", bytes(range(97, 120))):
        base = [bytes(r.choice(alpha) for _ in range(r.randint(200, 500))) for _ in range(4)] + [b"a" * 600]
        cut = set()
        for _ in range(80):
            b = r.choice(base)
            s = r.randint(0, len(b) - 200)
            cut.add(b[s : r.randint(s + 200, len(b))] + bytes(r.choice(alpha) for _ in range(r.randint(0, 30))))
        cut = list(cut)
        c = Counter(x[i : i + 200] for x in cut for i in range(len(x) - 199))
        for x, f in zip(cut, suffix.suffix_windows(cut, 200)):
            assert f.tolist() == [c[x[i : i + 200]] > 1 for i in range(len(x) - 199)]


def test_difference_cover():
    cover, shift = suffix.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))
    assert all((a + shift[a, b]) % 32 in cover and (b + shift[a, b]) % 32 in cover for a in range(32) for b in range(32))


def test_words_and_hashes():
    rows = ["One two  two", None, "", "Ä\x0bb\x1cc d", " x "]
    col = pa.array(rows)
    data, off = common.texts(col)
    starts, ends, first = common.word_spans(data, off)
    found = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert found == [(t or "").encode().split() for t in rows]
    h = common.word_hashes(data, starts, ends)
    assert h[1] == h[2] != h[0]


def test_empty_tables(frame):
    none = frame([])
    assert minhash.near_duplicates(none).count() == 0
    assert superkmer.substring_dedup(none).count() == 0
    assert suffix.suffix_dedup(none).count() == 0


def test_substrings_with_null_ids_equal_rows_and_clashing_names(spark):
    """Rows are judged one by one: a repeated row is a repeat, whatever its id; columns of the added names are replaced."""
    r = random.Random(6)
    words = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    passage = words(50)
    rows = [(1, passage + " " + words(9)), (1, passage), (None, words(60)), (2, words(45)), (2, None), (None, None), (3, ""), (4, words(40))]
    rows += [rows[2], rows[7]]
    docs = spark.createDataFrame([(i, t, "x", 5, "y", 1.5) for i, t in rows], "doc_id long, text string, n_words string, n_removed int, kept_text string, rid double")
    for f, brute, n in ((superkmer.substring_dedup, brute_words, "n_words"), (suffix.suffix_dedup, brute_bytes, "n_bytes")):
        # The plain form tells rows apart by place.
        expected = brute([(k, t) for k, (_, t) in enumerate(rows)])
        got = f(docs)
        assert sorted(set(docs.columns) - {"n_words", "n_removed", "kept_text"}) == sorted(set(got.columns) & {"doc_id", "text", "rid"})
        got = [(x["doc_id"], x["text"], x[n], x["n_removed"]) for x in got.collect()]
        assert sorted(got, key=str) == sorted([(i, t, expected[k][0], expected[k][1]) for k, (i, t) in enumerate(rows)], key=str)
        assert f(docs.limit(0)).count() == 0


def test_blocks_do_not_depend_on_the_partitioning(spark, frame, monkeypatch):
    """Members of one unit fill blocks of the same sizes over 4 and over 48 partitions."""
    r = random.Random(5)
    word = lambda: "w%d" % r.randrange(10**6)
    common_part = [word() for _ in range(40)]
    rows = [(i, " ".join(common_part + [word() for _ in range(14)])) for i in range(40)]
    made, keep = [], minhash.Scratch.keep

    def counted(self, df, name="t", codec="zstd"):
        out = keep(self, df, name, codec)
        if name == "blocks":
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash.Scratch, "keep", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "48"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            minhash.near_duplicates(frame(rows), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 2 and made[0] == made[1]
