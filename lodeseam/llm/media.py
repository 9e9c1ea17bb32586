"""Media columns: texts stored as motion-JPEG AVI files, and the timed clips of such files."""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseam.llm import avi
from lodeseam.llm.base import in_arrow, whole_text
from lodeseam.llm.tokens import released, slices


def payload(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(avi.BLOCK, -(-len(raw) // avi.BLOCK) * avi.BLOCK), b"\0")


def media_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and media (one AVI file) of every row; a null text counts as empty."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([avi.write(payload(t)) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(id_col, whole_text(text_col).alias("_text")), run, f"`{id_col}` {kind}, media binary")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot of every file: `id_col`, clip (from 0), first_frame, last_frame, start_ms, end_ms, error.

    A null file and one without frames have no clips. A file that cannot be read gives one row, whose clip is
    null and whose error says why; for all others error is null.
    """

    def timed(data: bytes) -> list[tuple]:
        try:
            video = avi.parse(data)
            if not video.frames:
                return []
            found = avi.shots(avi.histograms(avi.decode(video.frames)))
            return [(k, a, b, 1000 * a * video.scale // video.rate, 1000 * (b + 1) * video.scale // video.rate, None) for k, (a, b) in enumerate(found)]
        except (ValueError, struct.error, ZeroDivisionError) as e:
            return [(None,) * 5 + (str(e),)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = [(i, *r) for i, data in zip(*(c.to_pylist() for c in part.columns), strict=True) if data is not None for r in timed(data)]
            if rows:
                ids, *rest, errors = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), *(pa.array(c, pa.int64()) for c in rest), pa.array(errors, pa.string())], [id_col, *names, "error"])

    names = ("clip", "first_frame", "last_frame", "start_ms", "end_ms")
    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(id_col, media_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", error string")


def _feature(video: avi.Video, frames: list[avi.Frame]) -> str:
    """Frame count and size, clips in milliseconds and the brightness profile of the whole file."""
    hist = avi.histograms(frames)
    timed = ",".join(f"{1000 * a * video.scale // video.rate}-{1000 * (b + 1) * video.scale // video.rate}" for a, b in avi.shots(hist))
    return f"{len(frames)}x{frames[0].width}x{frames[0].height};{timed};{'.'.join(map(str, hist.sum(axis=0).tolist()))}"


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text written as a file, read back and measured; the files themselves stay on the executor.

    A null text counts as empty, whose payload is 64 zero bytes. Equal texts give equal values, whatever the
    machine or batch. Repeated rows are computed each for itself; an empty table gives no rows.
    """

    def rows(texts: list[str]) -> Iterator[tuple]:
        files = [avi.write(payload(t)) for t in texts]
        videos = [avi.parse(f) for f in files]
        frames = iter(avi.decode([f for v in videos for f in v.frames]))
        for text, media, video in zip(texts, files, videos, strict=True):
            own = list(itertools.islice(frames, len(video.frames)))
            back = avi.stored_bytes(video, own)
            yield len(text.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(video, own)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            columns = zip(*rows(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types, strict=True))
    return in_arrow(df.select(id_col, whole_text(text_col).alias("_text")), run, f"`{id_col}` {kind}, {schema}")
