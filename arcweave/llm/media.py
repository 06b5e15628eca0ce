"""Media columns: AVI with motion JPEG.

Bytes are stored as pictures of flat 8 x 8 blocks, one byte a block: grey frames of
BLOCKS_X x BLOCKS_Y blocks in a RIFF AVI file.  A flat block has only a DC coefficient,
and with quantiser 8 that is the sample less 128, so baseline JPEG holds it without
loss and any player shows the blocks.  The Huffman lengths are chosen so that code and
extra bits of a DC difference take 10 bits whatever its category, and the end of a
block takes 6: a block is one 16-bit word and no byte of the scan is 0xFF, which lets
numpy code and decode a whole file at once.

Reading goes by the file's own indexes and tables: RIFF chunks, ``idx1`` or OpenDML
indexes, and of each picture its quantisers, Huffman tables (the standard's where it
has none), sampling factors and restart intervals.  Any baseline picture is decoded in
full.  What is broken raises ValueError: every place and size a file states is checked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCKS_X, BLOCKS_Y = 16, 12
#: Bytes of a frame.
FRAME = BLOCKS_X * BLOCKS_Y
FPS = 25
QUANT = 8
#: Code bits of a DC difference of each category (0 to 8): with the category's extra bits 10 together.
DC_BITS = 10
EOB_BITS = 6
#: Histogram bins, and frames on either side that a shot boundary is judged by.
BINS, AROUND = 16, 4


# --------------------------------------------------------------------------- JPEG


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman code: by length, then in the order given."""
    code = last = 0
    out = {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in ordered) for k in range(1, 17))
    body = bytes([kind]) + counts + bytes(s for s, _ in ordered)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_DC_LENGTHS = {s: DC_BITS - s for s in range(8, -1, -1)}


def _header() -> bytes:
    dqt = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([QUANT]) * 64
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8 * BLOCKS_Y, 8 * BLOCKS_X, 1) + b"\x01\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x00\x3f\x00"
    return b"\xff\xd8" + dqt + sof + _dht(0x00, _DC_LENGTHS) + _dht(0x10, {0: EOB_BITS}) + sos


HEADER, TRAILER = _header(), b"\xff\xd9"


def _block_words(dc: dict[int, tuple[int, int]], eob: tuple[int, int]) -> np.ndarray | None:
    """The 16-bit word of each DC difference -255 to 255 (at difference + 255), if all blocks take 16 bits under these tables."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        if s not in dc:
            return None
        code, n = dc[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        if n + s + eob[1] != 16:
            return None
        out[d + 255] = (code << s | extra) << eob[1] | eob[0]
    return out


WORDS = _block_words(_canonical(_DC_LENGTHS), _canonical({0: EOB_BITS})[0])


def encode_frames(samples: np.ndarray) -> np.ndarray:
    """(frames, FRAME) samples to (frames, bytes) JPEG pictures, all of one size."""
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.zeros((len(level), 1), np.int16))
    scan = WORDS[diff + 255].astype(">u2").view(np.uint8).reshape(len(level), -1)
    n = len(level)
    head, tail = np.frombuffer(HEADER, np.uint8), np.frombuffer(TRAILER, np.uint8)
    return np.concatenate((np.broadcast_to(head, (n, len(head))), scan, np.broadcast_to(tail, (n, len(tail)))), axis=1)


# Fixed values of the JPEG standard: the zigzag order of coefficients (by rule), and for
# pictures without Huffman tables those of its annex K: codes of each length, then symbols.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}

#: [u, x]: the inverse cosine transform of 8 values.
COSINE = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def _code_table(counts: bytes, symbols: bytes) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """(symbol -> (code, length); for every 16 bits ahead length * 256 + symbol, 0 for no code)."""
    if len(counts) != 16 or len(symbols) < sum(counts):
        raise ValueError("broken Huffman table")
    lengths = [k + 1 for k, n in enumerate(counts) for _ in range(n)]
    if sum(1 << 16 - n for n in lengths) > 1 << 16:
        raise ValueError("broken Huffman table")
    ahead, at = np.zeros(1 << 16, np.int32), 0
    for symbol, n in zip(symbols, lengths):
        ahead[at : at + (1 << 16 - n)] = n << 8 | symbol
        at += 1 << 16 - n
    return _canonical(dict(zip(symbols, lengths))), ahead.tolist()


@dataclass
class Part:
    """A component: sampling factors, quantiser, blocks, and the coefficients found."""

    name: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks without padding
    down: int = 0
    coefficients: np.ndarray | None = None


class Picture:
    """A baseline JPEG picture: what its markers say, and its coefficients."""

    def __init__(self, jpeg: bytes):
        self.jpeg, self.at = jpeg, 2
        self.quants: dict[int, np.ndarray] = {}
        self.codes = {k: _code_table(bytes.fromhex(c), bytes.fromhex(s)) for k, (c, s) in STANDARD.items()}
        self.parts: list[Part] = []
        self.width = self.height = self.restart = 0
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG picture")

    def to_scan(self) -> list[tuple[Part, int, int]] | None:
        """Reads markers up to the next scan: its parts with their DC and AC tables; None at the end of the picture."""
        while True:
            if self.at + 2 > len(self.jpeg) or self.jpeg[self.at] != 0xFF:
                raise ValueError("broken JPEG marker")
            marker = self.jpeg[self.at + 1]
            if marker == 0xFF:
                self.at += 1
                continue
            if marker == 0xD9:
                return None
            if self.at + 4 > len(self.jpeg):
                raise ValueError("broken JPEG marker")
            size = struct.unpack_from(">H", self.jpeg, self.at + 2)[0]
            body = self.jpeg[self.at + 4 : self.at + 2 + size]
            if size < 2 or len(body) < size - 2:
                raise ValueError("broken JPEG marker")
            self.at += 2 + size
            if marker == 0xDA:
                return self._scan(body)
            self._marker(marker, body)

    def _marker(self, marker: int, body: bytes) -> None:
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4 != 0)
                if len(body) < 1 + 64 * wide:
                    raise ValueError("broken quantiser")
                self.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or self.parts:
                raise ValueError("broken frame header")
            depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not self.width or not self.height or not 1 <= n <= 4 or len(body) < 6 + 3 * n:
                raise ValueError("only 8-bit pictures of up to four components")
            self.parts = [Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            if not all(1 <= p.h <= 4 and 1 <= p.v <= 4 for p in self.parts):
                raise ValueError("broken sampling factors")
            most_h, most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
            for p in self.parts:
                p.across = -(-(-(-self.width * p.h // most_h)) // 8)
                p.down = -(-(-(-self.height * p.v // most_v)) // 8)
        elif 0xC1 < marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline pictures")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                self.codes[body[0]] = _code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            if len(body) < 2:
                raise ValueError("broken restart interval")
            self.restart = struct.unpack_from(">H", body)[0]

    def _scan(self, body: bytes) -> list[tuple[Part, int, int]]:
        n = body[0] if body else 0
        if not 1 <= n <= len(self.parts) or len(body) < 4 + 2 * n:
            raise ValueError("broken scan header")
        by_name = {p.name: p for p in self.parts}
        out = []
        for i in range(1, 1 + 2 * n, 2):
            part, dc, ac = by_name.get(body[i]), body[i + 1] >> 4, 16 | body[i + 1] & 15
            if part is None or dc not in self.codes or ac not in self.codes or part.quant not in self.quants:
                raise ValueError("a scan names what there is not")
            out.append((part, dc, ac))
        return out

    def read_scan(self, scan: list[tuple[Part, int, int]]) -> None:
        """Decodes the coefficients of a scan, restart interval by restart interval."""
        data = np.frombuffer(self.jpeg, np.uint8)[self.at :]
        marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0))
        ends, start, segments = None, 0, []
        for m in marks.tolist():
            if data[m + 1] == 0xFF:
                continue
            segments.append(data[start:m])
            start = m + 2
            if not 0xD0 <= data[m + 1] <= 0xD7:
                ends = m
                break
        if ends is None:
            raise ValueError("a scan without end")
        self.at += ends
        if len(scan) == 1:
            # A scan of one part goes block by block, without padding.
            part = scan[0][0]
            across, down, units = part.across, part.down, [(scan[0], [(0, 0)], 1, 1)]
        else:
            most_h, most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
            across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
            units = [(s, [(y, x) for y in range(s[0].v) for x in range(s[0].h)], s[0].v, s[0].h) for s in scan]
        # A block takes two bits at least.
        if across * down * sum(len(u[1]) for u in units) * 2 > 8 * ends:
            raise ValueError("a scan too short for its picture")
        for (part, _, _), _, v, h in units:
            part.coefficients = np.zeros((down * v, across * h, 64), np.int32)
        each = self.restart or across * down
        if len(segments) < -(-across * down // each):
            raise ValueError("a restart interval is missing")
        for k in range(-(-across * down // each)):
            self._segment(segments[k].tobytes().replace(b"\xff\x00", b"\xff"), units, range(k * each, min((k + 1) * each, across * down)), across)

    def _segment(self, data: bytes, units: list, mcus: range, across: int) -> None:
        raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
        ahead = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
        at, end, order = 0, 8 * len(data), ZIGZAG.tolist()
        tables = [(self.codes[dc][1], self.codes[ac][1]) for (_, dc, ac), _, _, _ in units]
        last = [0] * len(units)
        for mcu in mcus:
            row, column = divmod(mcu, across)
            for u, ((part, _, _), places, v, h) in enumerate(units):
                dc, ac = tables[u]
                for y, x in places:
                    out, k, table = part.coefficients[row * v + y, column * h + x], 0, dc
                    while k < 64:
                        if at >= end:
                            raise ValueError("a scan ends early")
                        found = table[ahead[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                        if not found:
                            raise ValueError("no such code")
                        at += found >> 8
                        run, size = (found & 255) >> 4, found & 15
                        if k == 0 and (run or size > 11):
                            raise ValueError("broken DC code")
                        value = 0
                        if size:
                            if at + size > end:
                                raise ValueError("a scan ends early")
                            value = ahead[at >> 3] >> 32 - size - (at & 7) & (1 << size) - 1
                            at += size
                            if not value >> size - 1:
                                value -= (1 << size) - 1
                        if k == 0:
                            last[u] += value
                            out[0] = last[u]
                            table = ac
                        elif not size and run != 15:
                            break
                        else:
                            k += run
                            if k > 63:
                                raise ValueError("a run beyond its block")
                            out[order[k]] = value
                        k += 1

    def plane(self, part: Part) -> np.ndarray:
        """Samples of a part at the size of the picture."""
        if part.coefficients is None:
            raise ValueError("a component without scan")
        if abs(part.coefficients).max(initial=0) > 1 << 15:
            raise ValueError("coefficients out of range")
        scale = np.empty(64)
        scale[ZIGZAG] = self.quants[part.quant]
        rows, columns = part.coefficients.shape[:2]
        blocks = COSINE.T @ (part.coefficients * scale).reshape(rows, columns, 8, 8) @ COSINE
        flat = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        most_h, most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        return flat[(np.arange(self.height) * part.v // most_v)[:, None], np.arange(self.width) * part.h // most_h]


def decode_picture(jpeg: bytes) -> np.ndarray:
    """(height, width, components) samples of a baseline picture; coarser components are repeated, colours stay as stored."""
    p = Picture(jpeg)
    while (scan := p.to_scan()) is not None:
        p.read_scan(scan)
    if not p.parts:
        raise ValueError("a picture without frame")
    return np.stack([p.plane(x) for x in p.parts], axis=2)


@dataclass
class Flat:
    """A grey picture whose blocks are 16-bit words: where its scan begins, blocks, quantiser, DC difference of each word (1 << 14: not a block)."""

    scan_at: int
    blocks: int
    quant: int
    back: np.ndarray


@lru_cache(maxsize=64)
def _by_header(header: bytes) -> Flat | None:
    p = Picture(header)
    scan = p.to_scan()
    if scan is None or len(p.parts) > 1 or p.restart:
        return None
    part, dc, ac = scan[0]
    codes = p.codes[ac][0]
    words = _block_words(p.codes[dc][0], codes[0]) if 0 in codes else None
    if words is None:
        return None
    back = np.full(1 << 16, 1 << 14, np.int16)
    back[words] = np.arange(-255, 256)
    return Flat(p.at, part.across * part.down, int(p.quants[part.quant][0]), back)


def _header_of(jpeg: bytes) -> bytes:
    """The picture up to its first scan."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        scan = jpeg[at + 1] == 0xDA
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
        if scan:
            break
    return jpeg[:at]


def decode_flat(pictures: np.ndarray) -> np.ndarray | None:
    """(frames, bytes) equal-sized pictures to the samples (frames, blocks) of their flat blocks, all at once.

    None unless they share tables and size and every block is a 16-bit word under these.
    """
    header = pictures[0].tobytes()
    if header[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    flat = _by_header(_header_of(header))
    if flat is None:
        return None
    end = flat.scan_at + 2 * flat.blocks
    if pictures.shape[1] < end + 2 or (pictures[:, : flat.scan_at] != pictures[0, : flat.scan_at]).any() or (pictures[:, end : end + 2] != (0xFF, 0xD9)).any():
        return None
    scan = np.ascontiguousarray(pictures[:, flat.scan_at : end])
    diff = flat.back[scan.view(">u2")]
    # No byte stuffing, and no word that isn't a block.
    if (scan == 0xFF).any() or (diff == 1 << 14).any():
        return None
    return np.clip(np.cumsum(diff, axis=1, dtype=np.int32) * flat.quant // 8 + 128, 0, 255).astype(np.uint8)


# --------------------------------------------------------------------------- AVI


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file of ``payload`` (a positive multiple of FRAME bytes)."""
    pictures = encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME))
    n, size = pictures.shape
    pad = size & 1
    width, height = 8 * BLOCKS_X, 8 * BLOCKS_Y
    avih = struct.pack("<14I", 1_000_000 // FPS, FPS * size, 0, 0x10, n, 0, 1, size, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = b"LIST" + struct.pack("<I", 4 + 16 + len(strh) + len(strf)) + b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    head = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    frames = np.concatenate((np.broadcast_to(head, (n, 8)), pictures, np.zeros((n, pad), np.uint8)), axis=1)
    movi = _chunk(b"LIST", b"movi" + frames.tobytes())
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.arange(n) * (8 + size + pad)
    index[:, 3] = size
    body = b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(media: bytes, at: int, end: int):
    """(name, kind of a list or b"", body start, body end) of the chunks in a range, lists with what is in them."""
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        stop = min(at + 8 + size, end)
        if name in (b"LIST", b"RIFF"):
            kind = media[at + 8 : at + 12]
            yield name, kind, at + 8, stop
            if kind != b"movi":
                yield from _chunks(media, at + 12, stop)
        else:
            yield name, b"", at + 8, stop
        at += 8 + size + (size & 1)


def _old_index(media: bytes, at: int, end: int, movi: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of the frames of a stream by an ``idx1`` chunk; places count from the frame list or from the file's start."""
    index = np.frombuffer(media, "<u4", (end - at) // 16 * 4, at).reshape(-1, 4)
    rows = index[np.isin(index[:, 0], [int.from_bytes(b"%02d" % stream + kind, "little") for kind in (b"dc", b"db")])]
    place = rows[:, 2].astype(np.int64)
    if len(rows):
        named = lambda p: media[max(p, 0) : max(p, 0) + 4] == rows[0, 0].astype("<u4").tobytes()
        if named(movi + int(place[0])):
            place += movi
        elif not named(int(place[0])):
            raise ValueError("an index entry without a frame")
    return place + 8, rows[:, 3].astype(np.int64)


def _new_index(media: bytes, at: int, end: int, deep: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and sizes of frames by an OpenDML index, which may be one of indexes."""
    if end - at < 24 or deep > 1:
        raise ValueError("broken index")
    longs, kind, n = struct.unpack_from("<HxBI", media, at)
    if n * 4 * longs > end - at - 24:
        raise ValueError("broken index")
    if kind == 0 and longs == 4:
        out = []
        for i in range(n):
            start, size = struct.unpack_from("<QI", media, at + 24 + 16 * i)
            if size < 8 or start + size > len(media):
                raise ValueError("an index entry beyond the file")
            out += _new_index(media, start + 8, start + size, deep + 1)
        return out
    if kind == 1 and longs == 2:
        base = struct.unpack_from("<Q", media, at + 12)[0]
        rows = np.frombuffer(media, "<u4", 2 * n, at + 24).reshape(-1, 2).astype(np.int64)
        if base > len(media):
            raise ValueError("an index entry beyond the file")
        return [(base + rows[:, 0], rows[:, 1] & 0x7FFFFFFF)]
    raise ValueError("unknown kind of index")


def frame_places(media: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """(place of each frame, its size, frames a second) of the first video stream, through the file's indexes."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = old = stream = None
    new: list[tuple[np.ndarray, np.ndarray]] = []
    fps, streams, current = float(FPS), 0, None
    for name, kind, at, end in _chunks(media, 0, len(media)):
        if kind == b"movi" and movi is None:
            movi = at
        elif name == b"strh":
            current, streams = streams, streams + 1
            if media[at : at + 4] == b"vids" and stream is None:
                if media[at + 4 : at + 8] != b"MJPG" or end - at < 28:
                    raise ValueError("not motion JPEG")
                stream = current
                scale, rate = struct.unpack_from("<II", media, at + 20)
                fps = rate / max(1, scale) or float(FPS)
        elif name == b"indx" and current is not None and current == stream:
            new += _new_index(media, at, end)
        elif name == b"idx1" and old is None:
            old = (at, end)
    if movi is None or stream is None or not new and old is None:
        raise ValueError("no frames or no index")
    if new:
        start, size = (np.concatenate([x[i] for x in new]) for i in (0, 1))
    else:
        start, size = _old_index(media, *old, movi, stream)
    if len(start) and (start.min() < 0 or size.min() < 4 or (start + size).max() > len(media)):
        raise ValueError("an index entry beyond the file")
    return start, size, fps


#: Most bytes of frames that are decoded together.
TOGETHER = 1 << 22


def _runs(start: np.ndarray, size: np.ndarray):
    """(first, end) of runs of equal-sized frames at one distance, of bounded length."""
    step = np.diff(start)
    breaks = np.flatnonzero(size[1:] != size[:-1]) + 1
    # A run also breaks where a distance is another than the one before.
    odd = np.flatnonzero(step[1:] != step[:-1]) + 2
    at = np.unique(np.concatenate(([0], breaks, odd, [len(start)])))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        most = max(1, TOGETHER // int(size[i]))
        for k in range(i, j, most):
            yield k, min(j, k + most)


def read_frames(media: bytes):
    """Frames a second, then arrays (frames, samples) of the frames in turn, a bounded number at a time.

    Samples are those of the flat blocks of a file by ``encode_avi``, or of any other
    with the like tables; else all of the first component (brightness).
    """
    start, size, fps = frame_places(media)
    yield fps
    raw = np.frombuffer(media, np.uint8)
    flat = None
    for i, j in _runs(start, size):
        # Every place is inside the file, so the grid is.
        step = int(start[i + 1] - start[i]) if j - i > 1 else 0
        grid = np.lib.stride_tricks.as_strided(raw[start[i] :], (j - i, int(size[i])), (step, 1), writeable=False)
        found = decode_flat(grid) if flat is not False else None
        if flat is None:
            flat = found is not None
        if flat and found is None:
            # Mixed with other pictures: blocks are not all of their samples.
            raise ValueError("frames of several kinds")
        if flat:
            yield found
        else:
            for frame in grid:
                yield decode_picture(frame.tobytes())[:, :, 0].reshape(1, -1)


def read_avi(media: bytes) -> tuple[np.ndarray, float]:
    """(samples (frames, samples of a frame), frames a second) of a motion-JPEG AVI file, see ``read_frames``."""
    fps, *found = read_frames(media)
    if len({f.shape[1] for f in found}) > 1:
        raise ValueError("frames of several sizes")
    return (np.concatenate(found) if found else np.zeros((0, FRAME), np.uint8)), fps


# --------------------------------------------------------------------------- shots


def histograms(frames: np.ndarray) -> np.ndarray:
    """(frames, BINS) shares of the sample values."""
    n = len(frames)
    at = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / max(1, frames.shape[1])


def shot_starts(frames: np.ndarray) -> np.ndarray:
    """First frames of the shots: frame 0, and those whose histogram differs from the frame before by
    more than mean plus two deviations of the differences AROUND them (and at least 0.1)."""
    return shot_starts_of(histograms(frames))


def shot_starts_of(h: np.ndarray) -> np.ndarray:
    """The same from the frames' histograms."""
    n = len(h)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    d = np.abs(np.diff(h, axis=0)).sum(axis=1)
    lo = np.maximum(np.arange(n - 1) - AROUND, 0)
    hi = np.minimum(np.arange(n - 1) + AROUND + 1, n - 1)
    s1, s2 = np.concatenate(([0], np.cumsum(d))), np.concatenate(([0], np.cumsum(d * d)))
    k = hi - lo - 1
    mean = (s1[hi] - s1[lo] - d) / np.maximum(k, 1)
    var = np.maximum((s2[hi] - s2[lo] - d * d) / np.maximum(k, 1) - mean * mean, 0)
    cut = (d > mean + 2 * np.sqrt(var)) & (d > 0.1) & (k > 0)
    return np.concatenate(([0], np.flatnonzero(cut) + 1))


# --------------------------------------------------------------------------- columns


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of FRAME bytes."""
    return text + b" " * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def store_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds ``media_col``, an AVI file of each whole text (null: empty) padded with spaces; other columns stay."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != media_col]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    schema = rows.drop("text").withColumn("media", F.lit(b"")).schema

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                media = [encode_avi(padded((t or "").encode())) for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(media, pa.binary())], names=[*part.schema.names[:-1], "media"])

    return rows.mapInArrow(run, schema).toDF(*names, media_col)


CLIPS = "doc_id long, clip int, start_s double, end_s double, n_frames int, mean double"


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: one a shot, with start and end in seconds, frames and mean sample.

    Frames are decoded a bounded number at a time; of each only its histogram and mean
    are held.  A null file has no clips; a broken one raises ValueError.  Ids may repeat
    or be null; an empty table gives an empty result; other columns are not read.
    """
    rows = media.filter(F.col(media_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for doc, m in zip(b.column("doc_id").to_pylist(), b.column("media")):
                fps, *seen = ((x if isinstance(x, float) else (histograms(x), x.mean(axis=1))) for x in read_frames(m.as_py()))
                means = np.concatenate([x[1] for x in seen] or [np.zeros(0)])
                starts = shot_starts_of(np.concatenate([x[0] for x in seen])) if seen else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(means))
                for k, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())):
                    for col, v in zip(out, (doc, k, a / fps, z / fps, z - a, float(means[a:z].mean()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()))], names=["doc_id", "clip", "start_s", "end_s", "n_frames", "mean"])

    return rows.mapInArrow(run, CLIPS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a file, reads the file back, and tells what was read.

    Null text counts as empty (one frame of spaces).  Equal texts give equal values;
    ids may repeat or be null; an empty table gives an empty result.  Payload digests
    are taken of the decoded samples, ``feature`` of the decoded frames: number of
    frames, number of shots, seconds to each shot's start, mean sample of each shot.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [[] for _ in range(7)]
                for t in part.column("text").to_pylist():
                    text = (t or "").encode()
                    media = encode_avi(padded(text))
                    frames, fps = read_avi(media)
                    payload = frames.tobytes()
                    starts = shot_starts(frames)
                    sums = np.add.reduceat(frames.sum(axis=1, dtype=np.int64), starts)
                    means = sums / (np.diff(np.append(starts, len(frames))) * frames.shape[1])
                    feature = f"frames={len(frames)};shots={len(starts)};at={','.join(f'{x:.2f}' for x in starts / fps)};mean={','.join(f'{x:.3f}' for x in means)}"
                    values = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                    for col, v in zip(out, values):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=[f.split()[0] for f in DIGEST.split(", ")])

    return rows.mapInArrow(run, DIGEST)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
