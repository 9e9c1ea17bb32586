"""Round trips of the AVI files, the entropy decoder against a plain one, shots, and the digest against brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from lodeseam.llm import avi, media


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 130, 700])
def test_round_trip_of_any_bytes(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes(), rng.integers(0, 255, 64 * n, dtype=np.uint8).tobytes(), b"\xff" * 64 * n, bytes(64 * n)):
        video = avi.parse(avi.write(data))
        assert avi.stored_bytes(video, avi.decode(video.frames)) == data
        assert len(video.frames) == -(-n // 64)
    with pytest.raises(ValueError):
        avi.write(b"abc")
    with pytest.raises(ValueError):
        avi.parse(b"RIFF....WAVE")


def bit_by_bit(scan, count, restart, dc, ac):
    """The coefficients of `count` blocks, read from strings of bits; tables map codes, as strings, to symbols."""
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", scan):
        bits, last = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff")), 0

        def symbol(table):
            nonlocal bits
            n = next(n for n in range(1, 17) if bits[:n] in table)
            found, bits = table[bits[:n]], bits[n:]
            return found

        def value(n):
            nonlocal bits
            taken, bits = bits[:n], bits[n:]
            return 0 if n == 0 else int(taken, 2) if taken[0] == "1" else int(taken, 2) - 2**n + 1

        for _ in range(min(restart or count, count - len(out))):
            last += value(symbol(dc))
            block = [last]
            while len(block) < 64:
                s = symbol(ac)
                if s == 0:
                    break
                block += [0] * (s >> 4)
                block.append(value(s & 15))
            out.append(block + [0] * (64 - len(block)))
    return np.array(out)


def huffman(kind, table):
    codes = sorted(table, key=lambda c: (len(c), c))
    return avi._segment(0xC4, bytes([kind, *(sum(len(c) == n for c in codes) for n in range(1, 17)), *(table[c] for c in codes)]))


def jpeg(scan, width, height, restart, dc, ac):
    head = avi._segment(0xDB, bytes([0] + [1] * 64)) + avi._segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + head + huffman(0, dc) + huffman(0x10, ac) + avi._segment(0xDD, struct.pack(">H", restart)) + avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_stored_files_agree_with_a_plain_decoder():
    frame = avi.parse(avi.write(bytes(range(256)) * 4)).frames[0]
    scan = frame[frame.index(b"\xff\xda") + 10 : frame.rindex(b"\xff\xd9")]
    table = {"00000000": 8}
    assert (avi.decode([frame])[0].blocks == bit_by_bit(scan, 16, 1, table, table)).all()


#: Canonical codes: categories 0 to 5; end of block, runs and a run of sixteen zeros.
DC = {"00": 0, "010": 1, "011": 2, "100": 3, "101": 4, "110": 5}
AC = {"00": 0x00, "01": 0x01, "100": 0x21, "1010": 0xF0, "1011": 0x14, "1100": 0x03}


def coded(rng, blocks, restart):
    """Random blocks by the tables above, stuffed, with restart markers."""
    parts = []
    for at in range(0, blocks, restart or blocks):
        bits = ""
        for _ in range(min(restart or blocks, blocks - at)):
            code = list(DC)[rng.integers(6)]
            bits += code + "".join(rng.choice(["0", "1"], DC[code]))
            k = 1
            while k < 64:
                fits = [c for c, s in AC.items() if k + (s >> 4) < 64]
                code = fits[rng.integers(len(fits))] if rng.random() < 0.9 else "00"
                bits += code + "".join(rng.choice(["0", "1"], AC[code] & 15))
                if AC[code] == 0:
                    break
                k += (AC[code] >> 4) + 1
        bits += "1" * (-len(bits) % 8)
        parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00"))
    return b"".join(p + (b"" if i == len(parts) - 1 else bytes([0xFF, 0xD0 + i % 8])) for i, p in enumerate(parts))


def test_ordinary_huffman_tables_against_a_plain_decoder():
    rng = np.random.default_rng(3)
    shapes = [(64, 64, 0), (40, 16, 3), (8, 8, 1), (24, 80, 7), (16, 8, 0)]
    scans = [coded(rng, w * h // 64, r) for w, h, r in shapes]
    files = [jpeg(s, w, h, r, DC, AC) for s, (w, h, r) in zip(scans, shapes, strict=True)]
    own = avi.parse(avi.write(bytes(range(128)))).frames
    frames = avi.decode([*files[:3], *own, *files[3:]])  # tables change and change back
    for f, s, (w, h, r) in zip(frames[:3] + frames[4:], scans, shapes, strict=True):
        want = bit_by_bit(s, w * h // 64, r, DC, AC)
        assert (f.blocks == want).all() and np.count_nonzero(want) and (f.width, f.height) == (w, h)
    assert avi.decode(own)[0].blocks.tolist() == frames[3].blocks.tolist()


def test_broken_frames():
    frame = avi.parse(avi.write(bytes(range(128)))).frames[0]
    short = frame[:-40] + b"\xff\xd9"
    for bad in (b"", b"\xff\xd8", frame[:30], frame[:-2], short, frame.replace(b"\xff\xd0", b"\xff\xe0"), frame.replace(b"\xff\xc0", b"\xff\xc2"), b"x" * 50):
        with pytest.raises(ValueError):
            avi.decode([frame, bad])


def test_pixels_match_a_floating_transform():
    rng = np.random.default_rng(1)
    coef = rng.integers(-60, 60, (3, 64))
    square = np.zeros((3, 64))
    square[:, avi.ZIGZAG] = coef
    k = np.arange(8)
    b = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    want = np.clip(np.round(b.T @ square.reshape(3, 8, 8) @ b) + 128, 0, 255).reshape(3, 64)
    got = avi.luma(avi.Frame(coef, 24, 8, np.ones(64, int)))
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.02
    assert avi.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_shots():
    a, b = np.array([100, 0, 0]), np.array([0, 100, 0])
    assert avi.shots(np.stack([a, a, a, b, b, a])) == [(0, 2), (3, 4), (5, 5)]
    assert avi.shots(np.stack([a])) == [(0, 0)]


def test_digest_and_clips(docs, rows, empty):
    got = media.media_digest(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    seen = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert seen.setdefault(texts[r.doc_id], tuple(r[1:])) == tuple(r[1:])
    files = media.media_files(docs)
    assert {(len(r.media), hashlib.sha256(r.media).hexdigest()) for r in files.collect()} == {(r.media_bytes, r.media_sha256) for r in got}
    timed = media.clips(files).collect()
    assert {r.doc_id for r in timed} == set(texts)
    assert all(r.start_ms == 40 * r.first_frame and r.end_ms == 40 * (r.last_frame + 1) for r in timed)
    assert media.media_digest(empty).count() == 0 and media.clips(media.media_files(empty)).count() == 0


def test_clips_of_null_and_broken_files(spark):
    good = avi.write(bytes(64 * 70))
    files = [(1, None), (2, b""), (3, b"RIFF....WAVE"), (4, good), (5, good.replace(b"\xff\xc0", b"\xff\xc2")), (4, good)]
    got = media.clips(spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in files], "doc_id long, media binary")).collect()
    assert sorted(r.doc_id for r in got) == [2, 3, 4, 4, 5]
    assert all((r.error is None) == (r.doc_id == 4) == (r.clip is not None) for r in got)
