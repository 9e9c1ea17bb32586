"""Motion-JPEG AVI files in memory: writing, RIFF and index parsing, intra-frame decoding, shot detection.

A frame is a baseline grey JPEG. Bytes are stored without loss as quantised coefficients: the 8 magnitude
bits of a category-8 coefficient hold any byte, every quantiser is 1, and each block restarts prediction.
All frames, our own and any other baseline grey Huffman JPEG, go through one table-driven entropy decoder,
which reads a symbol of every restart interval of many frames at a time.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 64
FRAME_BLOCKS = 64
FPS = 25
BINS = 16
#: Frames are decoded together up to about this many blocks.
BLOCKS_AT_ONCE = 1 << 13
#: A cut needs this many times the mean of the last differences in its shot, and this share of the pixels.
TIMES_MEAN, LEAST_SHARE, MEMORY = 2, 8, 8


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: diagonals, odd ones downwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([r * 8 + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


ZIGZAG = zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64 whole numbers (2^20 times the weights): scan-order coefficients to row-major pixels, exactly summed."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << 20))


INVERSE = _inverse_transform()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(symbol: int, table: int) -> bytes:
    """A table with one symbol, its code eight zero bits."""
    return _segment(0xC4, bytes([table]) + bytes([0] * 7 + [1] + [0] * 8) + bytes([symbol]))


def _frame_head(width: int, height: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _huffman(8, 0x00) + _huffman(8, 0x10) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _scan(block: np.ndarray, last: bool, k: int) -> bytes:
    """One block's entropy-coded bytes with stuffing, and the marker after it."""
    body = b"".join(b"\x00" + (b"\xff\x00" if v == 255 else bytes([v])) for v in block.tolist())
    return body + (b"" if last else bytes([0xFF, 0xD0 + k % 8]))


def write(payload: bytes) -> bytes:
    """An AVI file that holds `payload`, whose length is a positive multiple of 64."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    each = min(FRAME_BLOCKS, len(blocks))
    count = -(-len(blocks) // each)
    width, height = (64, 64) if each == FRAME_BLOCKS else (8 * each, 8)
    full = np.zeros((count * each, BLOCK), np.uint8)
    full[: len(blocks)] = blocks
    head = _frame_head(width, height)
    coded = np.zeros((count, each, 2 * BLOCK + 2), np.uint8)
    coded[:, :, 1 : 2 * BLOCK : 2] = full.reshape(count, each, BLOCK)
    coded[:, :, 2 * BLOCK] = 0xFF
    coded[:, :, 2 * BLOCK + 1] = 0xD0 + np.arange(each) % 8
    plain = not (blocks == 255).any()
    frames = []
    for i in range(count):
        if plain:
            scan = coded[i].tobytes()[:-2]
        else:
            scan = b"".join(_scan(b, k == each - 1, k) for k, b in enumerate(full[i * each : (i + 1) * each]))
        frames.append(head + scan + b"\xff\xd9")
    return _riff(frames, width, height, len(payload))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def _riff(frames: list[bytes], width: int, height: int, length: int) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % length))
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf))) + info + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass(frozen=True)
class Video:
    """A parsed file: frame bytes in index order, seconds per frame as a ratio, payload length if it states one."""

    frames: list[bytes]
    scale: int
    rate: int
    length: int | None


def _walk(data: bytes, at: int, end: int):
    """(name, start, end) of each chunk; a list's name follows its tag."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        upto = min(at + 8 + size, end)
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, upto
        else:
            yield name, at + 8, upto
        at += 8 + size + size % 2


def parse(data: bytes) -> Video:
    """Read a RIFF AVI: headers, then the frames by its index, or in file order where it has none."""
    top = next(_walk(data, 0, len(data)), None)
    if top is None or top[0] != b"AVI " or data[:4] != b"RIFF":
        raise ValueError("not an AVI file")
    scale, rate, length, movi, index = 1, FPS, None, None, []
    for name, a, b in _walk(data, top[1], top[2]):
        if name == b"hdrl":
            for n, c, d in _walk(data, a, b):
                for m, e, _ in _walk(data, c, d) if n == b"strl" else ():
                    if m == b"strh" and data[e : e + 4] == b"vids":
                        scale, rate = struct.unpack_from("<II", data, e + 20)
        elif name == b"INFO":
            for n, c, d in _walk(data, a, b):
                text = data[c:d].rstrip(b"\0")
                if n == b"ICMT" and text.startswith(b"payload="):
                    length = int(text[8:])
        elif name == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("no frames")
    if index:
        base = movi[0] - 4
        if data[base + index[0][2] : base + index[0][2] + 4] != index[0][0]:
            base = 0  # offsets from the start of the file
        frames = [data[base + at + 8 : base + at + 8 + size] for tag, _, at, size in index if tag[2:] in (b"dc", b"db")]
    else:
        frames = [data[a:b] for name, a, b in _walk(data, *movi) if name[2:] in (b"dc", b"db")]
    return Video(frames, scale, rate, length)


@dataclass(frozen=True)
class Frame:
    """A decoded frame: coefficients in scan order per block, and its size in pixels."""

    blocks: np.ndarray
    width: int
    height: int
    quantiser: np.ndarray


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of one Huffman table."""
    out, code, at = {}, 0, 17
    for n in range(1, 17):
        for _ in range(body[n]):
            out[(n, code)] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def _lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """symbol << 8 | code length by the next 16 bits, of the first table and then of the second; 0 is no code."""
    out = np.zeros((2, 1 << 16), np.int64)
    for row, body in zip(out, (dc, ac), strict=True):
        for (n, code), symbol in _codes(body).items():
            row[code << 16 - n : code + 1 << 16 - n] = symbol << 8 | n
    return out.ravel()


@dataclass(frozen=True)
class Scan:
    """What a JPEG's headers say of its one scan, and the scan's bytes."""

    data: bytes
    blocks: int
    restart: int
    tables: tuple[bytes, bytes]
    width: int
    height: int
    quantiser: np.ndarray


def scan_of(jpeg: bytes) -> Scan:
    """Read the headers of a baseline grey JPEG; ValueError if it is none."""
    at, tables, quantisers, restart, size, used = 2, {}, {}, 0, None, (0, 0, 0)
    try:
        while True:
            if jpeg[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + n]
            if marker == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4))
                    quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], np.uint8 if wide == 64 else ">u2").astype(np.int64)
                    body = body[1 + wide :]
            elif marker == 0xC4:
                while body:
                    used_up = 17 + sum(body[1:17])
                    tables[body[0]] = body[:used_up]
                    body = body[used_up:]
            elif marker == 0xC0:
                precision, height, width, parts = struct.unpack_from(">BHHB", body)
                if precision != 8 or parts != 1:
                    raise ValueError("only 8-bit grey frames")
                size, used = (width, height), (0, 0, body[8])
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only baseline frames")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            at += 2 + n
            if marker == 0xDA:
                used = (body[2] >> 4, 0x10 | (body[2] & 15), used[2])
                break
        width, height = size
        count = -(-width // 8) * -(-height // 8)
        return Scan(jpeg[at : jpeg.rindex(b"\xff\xd9")], count, restart, (tables[used[0]], tables[used[1]]), width, height, quantisers[used[2]])
    except (IndexError, KeyError, TypeError, struct.error) as e:
        raise ValueError(f"not a whole baseline JPEG: {e!r}") from e


def decode(jpegs: list[bytes]) -> list[Frame]:
    """The frames of baseline grey JPEGs, in order; ValueError if one is none."""
    scans, out, at = [scan_of(j) for j in jpegs], [], 0
    while at < len(scans):
        upto, blocks = at, 0
        while upto < len(scans) and (upto == at or blocks + scans[upto].blocks <= BLOCKS_AT_ONCE and scans[upto].tables == scans[at].tables):
            blocks += scans[upto].blocks
            upto += 1
        some = scans[at:upto]
        ends = np.cumsum([s.blocks for s in some])
        found = _coefficients(some)
        out += [Frame(found[e - s.blocks : e], s.width, s.height, s.quantiser) for s, e in zip(some, ends.tolist(), strict=True)]
        at = upto
    return out


def _segments(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The scans' bytes without stuffing and markers, and first byte, end and number of blocks of each restart interval."""
    data = np.frombuffer(b"".join(s.data + b"\xff\xd0" for s in scans), np.uint8)
    high = np.flatnonzero(data[:-1] == 0xFF)
    after = data[high + 1]
    marks = high[(after >= 0xD0) & (after <= 0xD7)]
    if len(marks) + int((after == 0).sum()) != len(high):
        raise ValueError("a marker inside a scan")
    keep = np.ones(len(data), bool)
    keep[high + 1] = False
    keep[marks] = False
    ends = np.cumsum(keep)[marks]
    blocks = [np.minimum(s.restart or s.blocks, s.blocks - np.arange(0, s.blocks, s.restart or s.blocks or 1)) for s in scans]
    closes = np.cumsum([len(s.data) + 2 for s in scans]) - 2  # the mark put after each scan
    if (np.searchsorted(marks, closes, side="right") != np.cumsum([len(b) for b in blocks])).any():
        raise ValueError("not as many restart intervals as the size needs")
    return data[keep], np.concatenate([[0], ends[:-1]]), ends, np.concatenate(blocks)


def _coefficients(scans: list[Scan]) -> np.ndarray:
    """Coefficients of all blocks of scans with the same tables, one symbol of every restart interval in each round."""
    data, begins, ends, left = _segments(scans)
    table = _lookup(*scans[0].tables)
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    ahead = np.zeros(len(data) + 1, np.uint64)  # the five bytes from each on, highest first
    for k in range(5):
        ahead |= raw[k : k + len(ahead)] << np.uint64(56 - 8 * k)
    out = np.zeros((int(left.sum()), 64), np.int32)
    block, limit, p = np.cumsum(left) - left, 8 * ends, 8 * begins
    k, last = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    while len(p):
        bits = ahead[p >> 3] << (p & 7).astype(np.uint64)
        code = table[(bits >> np.uint64(48)).astype(np.int64) + ((k > 0) << 16)]
        n, symbol = code & 255, code >> 8
        first = k == 0
        size, run = symbol & 15, np.where(first, 0, symbol >> 4)
        value = (bits << n.astype(np.uint64) >> np.uint64(48)).astype(np.int64) >> 16 - size
        half = 1 << size >> 1
        value = np.where(value < half, value - 2 * half + 1, value)
        last = np.where(first, last + value, last)
        p = p + n + size
        k = k + run
        stop = ~first & (size == 0) & (run != 15)
        if not n.all() or (p > limit).any() or (k[~stop] > 63).any():
            raise ValueError("no such code, or a block or scan that is too short")
        put = np.flatnonzero(first | (size > 0))
        out[block[put], k[put]] = np.where(first, last, value)[put]
        k = np.where(stop, 64, k + 1)
        done = k > 63
        if done.any():
            block, left, k = block + done, left - done, np.where(done, 0, k)
            if not left.all():
                more = left > 0
                block, left, limit, p, k, last = (x[more] for x in (block, left, limit, p, k, last))
    return out


def stored_bytes(video: Video, frames: list[Frame]) -> bytes:
    """The payload that write() stored."""
    blocks = np.concatenate([f.blocks for f in frames])
    return np.where(blocks > 0, blocks, blocks + 255).astype(np.uint8).tobytes()[: video.length]


def luma(frame: Frame) -> np.ndarray:
    """Pixels of the blocks, row-major in each, 0 .. 255; whole-number arithmetic, the same on any machine."""
    pixels = (frame.blocks * frame.quantiser).astype(np.float64) @ INVERSE
    return np.clip(np.floor(pixels / (1 << 20) + 0.5) + 128, 0, 255).astype(np.int64)


def histograms(frames: list[Frame]) -> np.ndarray:
    """Frames by BINS: how many pixels of each frame are in each range of brightness."""
    return np.stack([np.bincount(luma(f).ravel() >> 4, minlength=BINS) for f in frames])


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    A frame starts a shot if its histogram differs from the one before by a share of the pixels and by
    several times the mean of the last differences inside the current shot.
    """
    gaps = np.abs(np.diff(hist, axis=0)).sum(axis=1).tolist()
    pixels, starts, recent = int(hist[0].sum()), [0], []
    for i, gap in enumerate(gaps, 1):
        if gap * LEAST_SHARE >= pixels and gap * max(1, len(recent)) >= TIMES_MEAN * sum(recent):
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - MEMORY :], gap]
    return list(zip(starts, [s - 1 for s in starts[1:]] + [len(hist) - 1], strict=True))
