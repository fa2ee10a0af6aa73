"""Media columns: AVI with motion JPEG.

A payload becomes a clip: each byte is the grey value of one 8 x 8 block of a
512 x 64 picture, so 512 bytes are a frame and 64 bytes a row of blocks. The
quantiser of the constant part is 8, which makes that part of a block exactly
its grey value less 128: baseline JPEG, and without loss. Restart markers
after each block make the code of every block two bytes, so that pictures are
coded and decoded by table, all at once. The RIFF file has an index, which
the reader follows to the frames. The number of payload bytes is a comment in
the INFO list; the last frame is filled up with zeros.

Other clips are read as well: any baseline JPEG, with or without restarts,
colours and tables of its own, is decoded bit by bit, and the mean of each 8 x 8
block of its luminance stands for the block. ``samples`` gives whole pictures.

Shots: the histograms of neighbouring frames differ by some share of their
blocks; a frame opens a shot where this exceeds the mean of the differences
around it by SIGMAS of their deviations and LEAST. Of a last frame that is
filled up only the filled blocks count, and as the histogram of a few blocks
differs by chance, LEAST grows by what that makes. ``clips`` gives timed rows.

Defined cases: a null or empty text is one of no bytes and a payload of 64
zeros; equal texts give equal values; repeated rows are kept; an empty table
gives an empty result; other columns are ignored. A file that can't be read is
one row of ``clips`` that says why; a null file gives none. Memory is about
twelve times the largest text, in one task. A RIFF file ends at 4 GB, so a text of more than
about 980 MB raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

UNIT, WIDE, HIGH = 64, 64, 8
FRAME = WIDE * HIGH
RATE = 25
WINDOW, SIGMAS, LEAST = 8, 2.0, 0.25
#: Code lengths of the size classes of the constant part: 4 bits for 4 to 8, 8 bits for 0 to 3.
CLASSES = ((4, (4, 5, 6, 7, 8)), (8, (0, 1, 2, 3)))
# The Huffman tables of motion JPEG that has none of its own (code counts, symbols), by class and number.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: ("0002010303020403050504040000017d",
           "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
           "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    0x11: ("00020102040403040705040400010277",
           "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
           "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
}
#: Row and column of the coefficients in their order.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))


def segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def huffman(kind: int, classes) -> bytes:
    counts = [0] * 16
    for length, symbols in classes:
        counts[length - 1] = len(symbols)
    return segment(0xC4, bytes([kind, *counts, *(s for _, symbols in classes for s in symbols)]))


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical codes of a table: symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def block_code(value: int, constant: dict[int, tuple[int, int]], rest: dict[int, tuple[int, int]], scale: int) -> int:
    """The two bytes of a block of one grey value: class, difference, end of block, ones."""
    level = (value - 128) * 8 // scale
    size = abs(level).bit_length()
    code, length = constant[size]
    bits = code << size | (level if level >= 0 else level + (1 << size) - 1)
    end, ends = rest[0]
    bits, used = bits << ends | end, length + size + ends
    if used > 16:
        raise ValueError("a block's code exceeds two bytes")
    return bits << 16 - used | (1 << 16 - used) - 1


@lru_cache(maxsize=8)
def coder(constant: tuple[bytes, bytes], rest: tuple[bytes, bytes], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Grey value -> two bytes, and two bytes -> grey value or -1."""
    to = np.array([block_code(v, codes(*constant), codes(*rest), scale) for v in range(256)], np.uint16)
    back = np.full(1 << 16, -1, np.int16)
    back[to] = np.arange(256)
    return to, back


@lru_cache(maxsize=1)
def head() -> bytes:
    quantisers = segment(0xDB, bytes([0, 8, *[1] * 63]))
    frame = segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0]))
    tables = huffman(0x00, CLASSES) + huffman(0x10, ((1, (0,)),))
    return b"\xff\xd8" + quantisers + frame + tables + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def coded(pixels: np.ndarray) -> np.ndarray:
    """Grey values (frames, FRAME) -> whole JPEG pictures (frames, bytes)."""
    constant, rest = (tuple(bytes(x) for x in table) for table in own_tables())
    to, _ = coder(constant, rest, 8)
    n, start = len(pixels), np.frombuffer(head(), np.uint8)
    out = np.empty((n, len(start) + 4 * FRAME), np.uint8)
    out[:, : len(start)] = start
    scan = out[:, len(start) :].reshape(n, FRAME, 4)
    pairs = to[pixels]
    scan[:, :, 0], scan[:, :, 1] = pairs >> 8, pairs & 0xFF
    scan[:, :, 2] = 0xFF
    scan[:, :, 3] = 0xD0 + np.arange(FRAME) % 8
    scan[:, -1, 3] = 0xD9  # the picture's end
    return out


def own_tables():
    return tables_of(head())[:2]


def tables_of(data: bytes) -> tuple[tuple[bytes, bytes], tuple[bytes, bytes], int, tuple[int, int], int]:
    """Tables of a picture's head: constant part, rest, quantiser, (blocks across, down), where the scan begins."""
    at, tables, scale, shape, restart = 2, {}, 0, (0, 0), 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    while True:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            scale = body[1]
        elif mark == 0xC4:
            tables[body[0]] = bytes(body[1:17]), bytes(body[17:])
        elif mark == 0xC0:
            high, wide = struct.unpack(">HH", body[1:5])
            shape = wide // 8, high // 8
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xDA:
            break
    if restart != 1:
        raise ValueError("only pictures with a restart after each block are read")
    return tables[0x00], tables[0x10], scale, shape, at


def decoded(pictures: np.ndarray) -> np.ndarray:
    """Pictures (frames, bytes) -> grey values (frames, blocks)."""
    constant, rest, scale, (wide, high), at = tables_of(pictures[0].tobytes())
    if not (pictures[:, :at] == pictures[0, :at]).all():
        raise ValueError("frames of different heads")
    _, back = coder(constant, rest, scale)
    scan = pictures[:, at:].reshape(len(pictures), wide * high, 4)
    marks = np.r_[0xD0 + np.arange(wide * high - 1) % 8, 0xD9].astype(np.uint8)
    values = back[scan[:, :, 0].astype(np.uint16) << 8 | scan[:, :, 1]]
    if (scan[:, :, 2] != 0xFF).any() or (scan[:, :, 3] != marks).any() or (values < 0).any():
        raise ValueError("a damaged picture")
    return values.astype(np.uint8)


# Pictures of others: baseline JPEG, bit by bit


@lru_cache(maxsize=32)
def lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """The next 16 bits -> (symbol, length of its code); (0, 0) for no code."""
    out = [(0, 0)] * (1 << 16)
    for symbol, (code, length) in codes(counts, symbols).items():
        low = code << 16 - length
        out[low : low + (1 << 16 - length)] = [(symbol, length)] * (1 << 16 - length)
    return out


class Bits:
    """A scan between two restarts."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.data, self.at = data + b"\xff" * 8, 0

    def peek(self) -> int:
        if self.at > self.size:
            raise ValueError("a damaged picture")
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 3], "big") >> 8 - (self.at & 7) & 0xFFFF

    def symbol(self, table: list[tuple[int, int]]) -> int:
        found, length = table[self.peek()]
        if not length:
            raise ValueError("a damaged picture")
        self.at += length
        return found

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        raw = self.peek() >> 16 - size
        self.at += size
        return raw if raw >> size - 1 else raw - (1 << size) + 1


def block(bits: Bits, constant, rest, before: int) -> np.ndarray:
    """The 64 coefficients of a block in their order."""
    out = np.zeros(64, np.int64)
    out[0] = before + bits.number(bits.symbol(constant))
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(rest), 16)
        if not size and run < 15:
            break
        k += run
        if size:
            if k > 63:
                raise ValueError("a damaged picture")
            out[k] = bits.number(size)
        k += 1
    return out


def samples(data: bytes) -> np.ndarray:
    """The luminance of a baseline picture, rows of 8 bit samples."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    tables = {k: (bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in STANDARD.items()}
    at, scales, parts, restart, high, wide = 2, {}, {}, 0, 0, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a damaged picture")
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wider = body[0] >> 4
                scales[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wider], ">u2" if wider else "u1").astype(np.int64)
                body = body[65 + 64 * wider :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1:17]), bytes(body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            high, wide = struct.unpack(">HH", body[1:5])
            parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        elif 0xC2 <= mark <= 0xCF:
            raise ValueError("only baseline pictures are read")
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xDA:
            break
    scan = [(body[k], tables[body[k + 1] >> 4], tables[0x10 | body[k + 1] & 15]) for k in range(1, 1 + 2 * body[0], 2)]
    if not (high and wide and scan and all(c in parts for c, _, _ in scan)):
        raise ValueError("a damaged picture")
    first = scan[0][0]
    most = [max(p[i] for p in parts.values()) for i in (0, 1)]
    if len(scan) == 1:  # blocks in rows
        shape = -(-wide * parts[first][0] // (8 * most[0])), -(-high * parts[first][1] // (8 * most[1]))
        step = {first: (1, 1)}
    else:
        shape = -(-wide // (8 * most[0])), -(-high // (8 * most[1]))
        step = {c: parts[c][:2] for c, _, _ in scan}
    readers = [(c, step[c], lookup(*constant), lookup(*rest)) for c, constant, rest in scan]
    across, down = step[first]
    found = np.zeros((shape[1] * down, shape[0] * across, 64), np.int64)
    units = shape[0] * shape[1]
    stretches = intervals(data, at)
    for k in range(0, units, restart or units):
        bits, before = Bits(next(stretches, b"")), dict.fromkeys(step, 0)
        for unit in range(k, min(units, k + (restart or units))):
            row, column = divmod(unit, shape[0])
            for c, (x_step, y_step), constant, rest in readers:
                for y in range(y_step):
                    for x in range(x_step):
                        made = block(bits, constant, rest, before[c])
                        before[c] = made[0]
                        if c == first:
                            found[row * down + y, column * across + x] = made
    return transformed(found * scales[parts[first][2]])[: -(-high * parts[first][1] // most[1]), : -(-wide * parts[first][0] // most[0])]


def intervals(data: bytes, at: int):
    """The stretches of a scan between its restart markers, without stuffed zeros."""
    start = at
    while True:
        at = data.find(b"\xff", at)
        mark = data[at + 1] if 0 <= at < len(data) - 1 else 0xD9
        if mark in (0x00, 0xFF):
            at += 2 - (mark == 0xFF)
            continue
        yield data[start : at if at >= 0 else len(data)].replace(b"\xff\x00", b"\xff")
        if not 0xD0 <= mark <= 0xD7:
            return
        at = start = at + 2


def transformed(found: np.ndarray) -> np.ndarray:
    """Coefficients (rows, columns, 64) of blocks -> samples."""
    rows, columns, _ = found.shape
    square = np.zeros((rows, columns, 8, 8))
    for k, (r, c) in enumerate(ZIGZAG):
        square[:, :, r, c] = found[:, :, k]
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1) / 2
    made = np.einsum("xu,abuv,yv->axby", basis, square, basis, optimize=True)
    return np.clip(np.round(made + 128), 0, 255).astype(np.uint8).reshape(8 * rows, 8 * columns)


def block_means(picture: np.ndarray) -> np.ndarray:
    """The rounded means of the whole 8 x 8 blocks, or of the picture if it has none."""
    high, wide = (8 * (n // 8) for n in picture.shape)
    if not (high and wide):
        return np.round(picture.mean(keepdims=True)).astype(np.uint8).ravel()
    return np.round(picture[:high, :wide].reshape(high // 8, 8, wide // 8, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


def greys(pictures: list[bytes]) -> np.ndarray:
    """Grey values (frames, blocks) of pictures of any kind."""
    if all(p.startswith(head()) and len(p) == len(pictures[0]) for p in pictures):
        return decoded(np.frombuffer(b"".join(pictures), np.uint8).reshape(len(pictures), -1))
    means = list(map(block_means, map(samples, pictures)))
    if len({len(m) for m in means}) > 1:
        raise ValueError("frames of different shapes")
    return np.stack(means)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def write_avi(payload: bytes) -> bytes:
    """The payload as an AVI file."""
    n = -(-len(payload) // FRAME)
    pixels = np.zeros(n * FRAME, np.uint8)
    pixels[: len(payload)] = np.frombuffer(payload, np.uint8)
    pictures = coded(pixels.reshape(n, FRAME))
    size = pictures.shape[1]
    odd = size % 2
    frames = np.zeros((n, 8 + size + odd), np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    frames[:, 8 : 8 + size] = pictures
    index = np.zeros(n, [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["name"], index["flags"], index["size"] = b"00dc", 0x10, size
    index["at"] = 4 + np.arange(n) * frames.shape[1]
    wide, high = 8 * WIDE, 8 * HIGH
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, size, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, n, size, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"bytes=%d\0" % len(payload)))
    movi = b"LIST" + struct.pack("<I", 4 + frames.size) + b"movi"
    idx1 = b"idx1" + struct.pack("<I", index.nbytes)
    length = 4 + len(hdrl) + len(info) + len(movi) + frames.size + len(idx1) + index.nbytes
    if length >= 1 << 32:
        raise ValueError("a RIFF file ends at 4 GB")
    return b"".join((b"RIFF", struct.pack("<I", length), b"AVI ", hdrl, info, movi, frames.tobytes(), idx1, index.tobytes()))


def read_avi(data: bytes) -> tuple[np.ndarray, int, float]:
    """Grey values (frames, blocks), bytes of the payload (-1: not stated), seconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    stated, movi, index, seconds = -1, 0, None, 1 / RATE
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, at + 8)[0] / 1e6
            elif name == b"ICMT" and data[at + 8 : at + 14] == b"bytes=":
                stated = int(data[at + 14 : at + 8 + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = np.frombuffer(data, [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at + 8)
            at += 8 + size + size % 2
    raw = np.frombuffer(data, np.uint8)
    if index is None or not len(index):
        starts, sizes = walked(data, movi)
    else:
        index = index[np.isin(index["name"], (b"00dc", b"00db"))]
        whole = movi if not len(index) or data.startswith(index["name"][0], movi + int(index["at"][0])) else 0  # some count from the file's start
        starts, sizes = whole + index["at"].astype(np.int64) + 8, index["size"].astype(np.int64)
    if not len(starts) or (starts + sizes).max() > len(data):
        raise ValueError("no frames, or frames that are cut off")
    step = int(starts[1] - starts[0]) if len(starts) > 1 else 0
    if (sizes == sizes[0]).all() and (np.diff(starts) == step).all() and data.startswith(head(), int(starts[0])) and len(head()) + 4 * FRAME == sizes[0]:
        pictures = np.lib.stride_tricks.as_strided(raw[starts[0] :], (len(starts), int(sizes[0])), (step, 1))
        return decoded(pictures), stated, seconds
    return greys([data[a : a + s] for a, s in zip(starts.tolist(), sizes.tolist())]), stated, seconds


def walked(data: bytes, movi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the frames of a file without an index."""
    found, at = [], movi + 4
    end = movi + struct.unpack_from("<I", data, movi - 4)[0] if movi else 0
    while movi and at + 8 <= min(end, len(data)):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] in (b"00dc", b"00db"):
            found.append((at + 8, size))
        at += 8 + size + size % 2
    starts, sizes = np.array(found, np.int64).reshape(-1, 2).T
    return starts, sizes


def shots(pixels: np.ndarray, filled: int | None = None) -> list[int]:
    """Frames that open a shot; the first is one. filled: blocks of the last frame that count, if not all do."""
    n, blocks = pixels.shape
    if n < 2:
        return [0]
    counts = np.full(n, blocks)
    counts[-1] = blocks if filled is None else filled
    bins = ((pixels >> 3).astype(np.int64) + 32 * np.arange(n)[:, None]).ravel()[: (n - 1) * blocks + counts[-1]]
    shares = np.bincount(bins, minlength=32 * n).reshape(n, 32) / counts[:, None]
    differ = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    low, high = np.maximum(np.arange(n - 1) - WINDOW, 0), np.minimum(np.arange(n - 1) + WINDOW + 1, n - 1)
    sums, squares = (np.r_[0, np.cumsum(x)] for x in (differ, differ * differ))
    count = high - low
    mean = (sums[high] - sums[low]) / count
    deviation = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean * mean, 0))
    least = LEAST + np.sqrt(8 / counts[1:]) - np.sqrt(8 / blocks)
    return [0, *(np.flatnonzero((differ > mean + SIGMAS * deviation) & (differ > least)) + 1).tolist()]


def features(pixels: np.ndarray, length: int) -> str:
    opens = shots(pixels, length - (len(pixels) - 1) * pixels.shape[1])
    flat = pixels.reshape(-1)[:length]
    return f"frames={len(pixels)};shots={len(opens)};sum={int(flat.sum(dtype=np.int64))};cuts={','.join(map(str, opens[1:]))}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(text: str | None) -> tuple:
    data = (text or "").encode()
    media = write_avi(pad(data))
    pixels, length, _ = read_avi(media)
    payload = pixels.reshape(-1)[:length].tobytes()
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels, length)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a clip, read it back, and describe it."""

    def run(ids, texts):
        rows = list(map(measured, texts))
        return [ids, *map(list, zip(*rows))] if rows else [[] for _ in RESULT.split(",")]

    return map_rows(docs.select(id_col, text_col), run, RESULT)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (AVI file)."""
    return map_rows(docs.select(id_col, text_col), lambda ids, texts: [ids, [write_avi(pad((t or "").encode())) for t in texts]], "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A timed row per shot of the clips in doc_id, media; one with the error alone of a file that can't be read."""

    def run(ids, files):
        rows = []
        for key, data in zip(ids, files):
            if data is None:
                continue
            try:
                pixels, length, seconds = read_avi(data)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                rows.append((key, None, None, None, None, None, str(e) or type(e).__name__))
                continue
            opens = shots(pixels, length - (len(pixels) - 1) * pixels.shape[1] if length >= 0 else None)
            for k, (a, b) in enumerate(zip(opens, [*opens[1:], len(pixels)])):
                rows.append((key, k, a, b, round(a * seconds, 6), round(b * seconds, 6), None))
        return [list(x) for x in zip(*rows)] or [[] for _ in range(7)]

    return map_rows(media.select("doc_id", "media"), run, "doc_id long, clip int, first_frame long, end_frame long, start_s double, end_s double, error string")
