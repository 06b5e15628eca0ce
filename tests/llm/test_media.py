"""op6: the JPEG decoder against a plain encoder and decoder, indexes of both kinds, broken files."""

import math
import random
import struct

import numpy as np
import pytest

from arcweave.llm import media

ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def plain_inverse(c):
    """64 coefficients to 64 samples by the formula."""
    out = []
    for y in range(8):
        for x in range(8):
            t = 0
            for v in range(8):
                for u in range(8):
                    a = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    t += a * c[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
            out.append(min(255, max(0, round(t + 128))))
    return out


def picture(r, width, height, sampling, restart=0, own_tables=False, apart=False):
    """A random JPEG picture, and its coefficients by part: blocks in rows, 64 each in natural order, dequantised."""
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    quant = [r.randint(1, 12) for _ in range(64)]
    codes = {k: media._code_table(bytes.fromhex(c), bytes.fromhex(s))[0] for k, (c, s) in media.STANDARD.items()}
    out = b"\xff\xd8" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(quant)
    if own_tables:
        for k in (0, 16):
            c, s = (bytes.fromhex(x) for x in media.STANDARD[k])
            out += b"\xff\xc4" + struct.pack(">HB", 3 + len(c) + len(s), k) + c + s
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(sampling), 8, height, width, len(sampling))
    out += b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    parts = [[[[0] * 64 for _ in range(across * h)] for _ in range(down * v)] for h, v in sampling]

    def scan(which):
        nonlocal out
        out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(which), len(which)) + b"".join(bytes([i + 1, 0]) for i in which) + b"\x00\x3f\x00"
        if len(which) == 1:
            h, v = sampling[which[0]]
            places = [[(which[0], y, x)] for y in range(-(-(-(-height * v // most_v)) // 8)) for x in range(-(-(-(-width * h // most_h)) // 8))]
        else:
            places = [[(i, my * sampling[i][1] + y, mx * sampling[i][0] + x) for i in which for y in range(sampling[i][1]) for x in range(sampling[i][0])] for my in range(down) for mx in range(across)]
        bits, last, mark = "", [0] * len(sampling), 0

        def put(code, n):
            nonlocal bits
            if n:
                bits += format(code, f"0{n}b")

        def flush():
            nonlocal bits, out
            bits += "1" * (-len(bits) % 8)
            out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
            bits = ""

        def value(table, run, x):
            n = abs(x).bit_length()
            put(*codes[table][run << 4 | n])
            put(x if x > 0 else x + (1 << n) - 1, n)

        for m, unit in enumerate(places):
            if restart and m and m % restart == 0:
                flush()
                out += bytes([0xFF, 0xD0 + mark % 8])
                mark, last = mark + 1, [0] * len(sampling)
            for i, y, x in unit:
                level, block = r.randint(-60, 60), parts[i][y][x]
                value(0, 0, level - last[i])
                last[i], block[0] = level, level * quant[0]
                k = 1
                while k < 64:
                    run = r.choice([0, 0, 1, 3, 17, 40])
                    if k + run > 63:
                        put(*codes[16][0])
                        break
                    k += run
                    while run > 15:
                        put(*codes[16][0xF0])
                        run -= 16
                    a = r.choice([-9, -2, -1, 1, 3])
                    value(16, run, a)
                    block[ZIGZAG[k]] = a * quant[k]
                    k += 1
        flush()

    for which in [[i] for i in range(len(sampling))] if apart else [list(range(len(sampling)))]:
        scan(which)
    return out + b"\xff\xd9", parts


def plain_planes(parts, width, height, sampling):
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    out = np.zeros((height, width, len(parts)), np.uint8)
    for i, (rows, (h, v)) in enumerate(zip(parts, sampling)):
        blocks = {}
        for y in range(height):
            for x in range(width):
                sy, sx = y * v // most_v, x * h // most_h
                at = (sy // 8, sx // 8)
                if at not in blocks:
                    blocks[at] = plain_inverse(rows[at[0]][at[1]])
                out[y, x, i] = blocks[at][8 * (sy % 8) + sx % 8]
    return out


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 2)]])
@pytest.mark.parametrize("restart, apart", [(0, False), (2, False), (0, True)])
def test_decoder(sampling, restart, apart):
    r = random.Random(str((sampling, restart, apart)))
    for width, height in ((8, 8), (19, 27)):
        jpeg, parts = picture(r, width, height, sampling, restart, r.random() < 0.5, apart)
        got = media.decode_picture(jpeg)
        assert got.shape == (height, width, len(sampling))
        assert np.abs(got.astype(int) - plain_planes(parts, width, height, sampling)).max() <= 1


def avi(pictures, index="old", absolute=False, stream=0):
    """An AVI file of pictures with an old or an OpenDML index."""
    chunk, four = media._chunk, b"%02ddc" % stream
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 2, 50, 0, len(pictures), 0, 0, 0, 0, 0, 8, 8)
    sound = b"LIST" + struct.pack("<I", 4 + 8 + 56) + b"strl" + chunk(b"strh", b"auds" + bytes(52))

    def build(places):
        new = b""
        if index == "new":
            new = chunk(b"indx", struct.pack("<HBBI4s3I", 4, 0, 0, 1, four, 0, 0, 0) + struct.pack("<QII", places["ix"], 32 + 8 * len(pictures), 0))
        video = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + new)
        out = b"RIFF" + bytes(4) + b"AVI " + chunk(b"LIST", b"hdrl" + sound * stream + video)
        movi, body, at = len(out) + 8, b"movi", []
        for p in pictures:
            at.append(len(body))
            body += chunk(four, p)
        if index == "new":
            entries = b"".join(struct.pack("<II", movi + a + 8 - places["base"], len(p)) for a, p in zip(at, pictures))
            places = {"ix": movi + len(body), "base": places["base"]}
            body += chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(pictures), four, places["base"], 0) + entries)
        out += chunk(b"LIST", body)
        if index == "old":
            out += chunk(b"idx1", b"".join(struct.pack("<4sIII", four, 16, a + movi * absolute, len(p)) for a, p in zip(at, pictures)))
        return out, places

    first, places = build({"ix": 0, "base": 100})
    out, _ = build(places)
    assert len(out) == len(first)
    return out[:4] + struct.pack("<I", len(out) - 8) + out[8:]


@pytest.mark.parametrize("how", [{"index": "old"}, {"index": "old", "absolute": True}, {"index": "new"}, {"index": "old", "stream": 1}])
def test_indexes(how):
    r = random.Random(1)
    made = [picture(r, 16, 8, [(2, 1), (1, 1), (1, 1)]) for _ in range(5)]
    frames, fps = media.read_avi(avi([j for j, _ in made], **how))
    assert fps == 25 and frames.shape == (5, 128)
    for f, (_, parts) in zip(frames, made):
        assert np.abs(f.reshape(8, 16).astype(int) - plain_planes(parts, 16, 8, [(2, 1), (1, 1), (1, 1)])[:, :, 0]).max() <= 1


def test_index_entries_are_checked():
    good = media.encode_avi(bytes(range(192)) * 4)
    at = good.index(b"idx1") + 8
    for place, value in ((12, 10**9), (12, 0), (12, 3), (8, 2**32 - 1), (8, 10**6), (8, 5), (16 + 12, 77), (16 + 12, 2**31)):
        bad = bytearray(good)
        struct.pack_into("<I", bad, at + place, value)
        with pytest.raises(ValueError):
            media.read_avi(bytes(bad))


def test_broken_files_only_raise():
    r = random.Random(8)
    files = [media.encode_avi(bytes(range(192)) * 3)]
    for how in ({"index": "old"}, {"index": "new"}):
        files.append(avi([picture(r, 16, 16, [(2, 2), (1, 1), (1, 1)], restart=1)[0] for _ in range(2)], **how))
    for good in files:
        for _ in range(400):
            bad = bytearray(good)
            for _ in range(r.choice([1, 1, 3])):
                bad[r.randrange(len(bad))] = r.choice([0, 255, r.randrange(256)])
            if r.random() < 0.3:
                del bad[r.randrange(len(bad)) :]
            try:
                frames, _ = media.read_avi(bytes(bad))
                assert frames.dtype == np.uint8
            except ValueError:
                pass


def plain_shots(frames):
    """Shot starts by loops."""
    hist = [[sum(16 * b <= s < 16 * b + 16 for s in f) / len(f) for b in range(16)] for f in frames.tolist()]
    d = [sum(abs(a - b) for a, b in zip(x, y)) for x, y in zip(hist, hist[1:])]
    out = [0] if len(frames) else []
    for i, x in enumerate(d):
        near = [d[j] for j in range(max(0, i - media.AROUND), min(len(d), i + media.AROUND + 1)) if j != i]
        if near:
            mean = sum(near) / len(near)
            if x > 0.1 and x > mean + 2 * (max(0, sum(z * z for z in near) / len(near) - mean * mean)) ** 0.5 + 1e-12:
                out.append(i + 1)
    return out


def test_shots_and_features(frame):
    r = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        runs = [(r.integers(32, 120), r.integers(1, 9)) for _ in range(r.integers(1, 7))]
        texts.append("".join("".join(chr(c + k % 3) for k in range(192 * n)) for c, n in runs))
    got = {x["doc_id"]: x for x in media.media_digests(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        raw += b" " * (-len(raw) % 192)
        frames = np.frombuffer(raw, np.uint8).reshape(-1, 192)
        starts = plain_shots(frames)
        ends = [*starts[1:], len(frames)]
        mean = [sum(map(int, frames[a:z].ravel())) / (192 * (z - a)) for a, z in zip(starts, ends)]
        assert got[i]["feature"] == f"frames={len(frames)};shots={len(starts)};at={','.join(f'{a / 25:.2f}' for a in starts)};mean={','.join(f'{m:.3f}' for m in mean)}"
        import hashlib

        stored = media.encode_avi(raw)
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        for k, f in enumerate(frames[:2]):
            at, size, _ = media.frame_places(stored)
            assert (media.decode_picture(stored[at[k] : at[k] + size[k]])[::8, ::8, 0].ravel() == f).all()


def test_names_may_clash(frame):
    docs = frame([(1, "a"), (None, None)]).withColumn("media", media.F.lit(1)).withColumn("c0", media.F.lit("x"))
    stored = media.store_media(docs)
    assert sorted(stored.columns) == sorted(docs.columns) and stored.schema["media"].dataType.simpleString() == "binary"
    assert media.clips(stored).count() == 2 and media.clips(stored.withColumn("media", media.F.lit(None).cast("binary"))).count() == 0
