"""Media columns in ISO base media containers: nested boxes, sample tables, and byte ranges of keyframes.

``stored_media`` puts bytes into a file of one sound track of unsigned 8-bit samples: 64 samples a frame, 16 frames a
chunk, the first frame of each chunk a keyframe. ``walk`` goes through the nested boxes of any such container, and
``tracks`` decodes its sample tables (stsd, stts, stsc, stsz, stco or co64, stss) to codec, duration and the byte range
of every sample, without touching the payload. Box sizes of 32 and 64 bits and up to the end are read, and both header
versions; damaged containers raise ValueError, and so do fragmented ones, whose samples are listed outside these tables.

``media_tracks`` adds these figures to any table with a binary media column: for every track, in order, its codec,
handler, timescale, duration, number of samples, and begin and end of every keyframe. A container may have any number of
tracks; null media have null tracks. ``media_metadata`` reads the boxes in front of the payload and their tables alone, so
no payload is decoded or hashed. ``media_digest`` returns the same columns and makes its feature string from them; null media
have null figures.

Null texts count as empty; an empty text has one frame of zeros. Equal texts have equal containers and features.
Repeated rows give a row each, null ids are carried along, other columns are ignored, an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import stored
from .segments import slices, whole_texts

FRAME, PER_CHUNK, RATE = 64, 16, 8000

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


#: Boxes lie no deeper than this in a real file.
DEEPEST = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
_HDLR = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
_DINF = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
_STSD = full_box(
    b"stsd",
    struct.pack(">I", 1),
    box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)),
)


def container(payload: bytes) -> bytes:
    """A file around ``payload``, whose length is a positive multiple of ``FRAME``."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    last = frames - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if last == PER_CHUNK else [(1, PER_CHUNK, 1), (chunks, last, 1)]
    if chunks == 1:
        runs = [(1, last, 1)]
    keys = np.arange(1, frames + 1, PER_CHUNK, dtype=">u4")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * FRAME * PER_CHUNK
        places = (
            full_box(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
            if len(payload) < 1 << 31
            else full_box(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes())
        )
        table = box(
            b"stbl",
            _STSD,
            full_box(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, frames)),
            places,
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        time = struct.pack(">QQIQ", 0, 0, RATE, len(payload))
        media = box(
            b"mdia",
            full_box(b"mdhd", time, struct.pack(">HH", 0x55C4, 0), version=1),
            _HDLR,
            box(b"minf", full_box(b"smhd", bytes(4)), _DINF, table),
        )
        head = struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload))
        track = full_box(b"tkhd", head, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        movie = full_box(
            b"mvhd", time, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1
        )
        return box(b"moov", movie, box(b"trak", track, media))

    size = len(moov(0))
    header = 8 if len(payload) + 8 < 1 << 32 else 16
    return _FTYP + moov(len(_FTYP) + size + header) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, begin and end of the content) of every box, parents first."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a long box header is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield depth, kind, body, stop
        if kind in CONTAINERS:
            if depth == DEEPEST:
                raise ValueError("boxes are nested too deeply")
            yield from walk(data, body, stop, depth + 1)
        start = stop


def _numbers(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    n = _fields(">I", data, at, end)[0]
    size = np.dtype(kind).itemsize
    if at + 4 + n * width * size > end:
        raise ValueError("a table is cut short")
    numbers = np.frombuffer(data, kind, n * width, at + 4)
    if size == 8 and n and int(numbers.max()) > len(data):
        raise ValueError("an offset lies outside the file")
    return numbers.astype(np.int64).reshape(-1, width)


def _fields(form: str, data: memoryview, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise ValueError("a box is cut short")
    return struct.unpack_from(form, data, at)


#: A duration of all ones in the header means that it is unknown.
_UNKNOWN = (1 << 64) - 1


class Track:
    """What one track's tables say; ``starts`` and ``sizes`` are the byte ranges of its samples."""

    def __init__(self):
        self.codec, self.handler, self.timescale, self.duration = "", "", 0, 0
        self.sizes = self.starts = np.zeros(0, np.int64)
        self.keys: np.ndarray | None = None
        self.ticks = 0
        self._stsc = self._chunks = np.zeros((0, 3), np.int64)

    def _read(self, data: memoryview, kind: bytes, a: int, b: int) -> None:
        if kind == b"mdhd":
            version = _fields("B", data, a, b)[0]
            at = (a + 20, ">IQ") if version == 1 else (a + 12, ">II")
            self.timescale, self.duration = _fields(at[1], data, at[0], b)
            if version != 1 and self.duration == (1 << 32) - 1:
                self.duration = _UNKNOWN
            if 1 << 63 <= self.duration < _UNKNOWN:
                raise ValueError("a duration is out of range")
        elif kind == b"hdlr":
            self.handler = _fields("4s", data, a + 8, b)[0].decode("latin-1")
        elif kind == b"stsd":
            self.codec = _fields("4s", data, a + 12, b)[0].decode("latin-1").strip()
        elif kind == b"stts":
            runs = _numbers(data, a + 4, b, ">u4", 2)
            self.ticks = int((runs[:, 0] * runs[:, 1]).sum())
        elif kind == b"stsc":
            self._stsc = _numbers(data, a + 4, b, ">u4", 3)
        elif kind == b"stsz":
            size, n = _fields(">II", data, a + 4, b)
            if size * n > len(data):
                raise ValueError("samples are larger than the file")
            self.sizes = np.full(n, size, np.int64) if size else _numbers(data, a + 8, b, ">u4")[:, 0]
        elif kind in (b"stco", b"co64"):
            self._chunks = _numbers(data, a + 4, b, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            self.keys = _numbers(data, a + 4, b, ">u4")[:, 0] - 1

    def _place(self, length: int) -> None:
        """Byte ranges of samples, from the chunks they lie in."""
        chunks = len(self._chunks)
        first = np.append(self._stsc[:, 0], chunks + 1)
        # What the runs say in total is known before they are written out.
        if len(self._stsc) and (first[0] != 1 or (np.diff(first) <= 0).any()):
            raise ValueError("runs of chunks are out of order")
        if int(self.sizes.sum()) > length:
            raise ValueError("samples are larger than the file")
        per_chunk = np.repeat(self._stsc[:, 1], np.diff(first)) if len(self._stsc) else np.zeros(0, np.int64)
        if len(per_chunk) != chunks or per_chunk.sum() != len(self.sizes):
            raise ValueError("sample tables disagree")
        if chunks and not per_chunk.all():
            raise ValueError("a chunk has no sample")
        chunk = np.repeat(np.arange(chunks), per_chunk)
        before = np.cumsum(self.sizes) - self.sizes
        begin = np.cumsum(per_chunk) - per_chunk
        self.starts = self._chunks[chunk] + before - before[begin[chunk]] if len(chunk) else np.zeros(0, np.int64)
        if len(chunk) and (self.starts + self.sizes).max() > length:
            raise ValueError("a sample lies outside the file")
        if self.keys is None:
            self.keys = np.arange(len(self.sizes))
        if len(self.keys) and not 0 <= self.keys.min() <= self.keys.max() < len(self.sizes):
            raise ValueError("a keyframe is not a sample")

    def key_ranges(self) -> np.ndarray:
        """Begin and end of every keyframe."""
        return np.stack([self.starts[self.keys], self.starts[self.keys] + self.sizes[self.keys]], axis=1)

    def payload(self, data: memoryview) -> bytes:
        """The stored bytes of all samples in order; neighbours are read together."""
        if not len(self.sizes):
            return b""
        ends = self.starts + self.sizes
        cut = np.flatnonzero(self.starts[1:] != ends[:-1]) + 1
        a, b = self.starts[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]
        return b"".join(data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))


def tracks(data: memoryview) -> list[Track]:
    """The tracks of a container in order, with their tables read and checked."""
    found: list[Track] = []
    for _, kind, a, b in walk(data):
        if kind == b"moof":
            raise ValueError("fragmented containers are not read")
        if kind == b"trak":
            found.append(Track())
        elif found:
            found[-1]._read(data, kind, a, b)
    for track in found:
        track._place(len(data))
    return found


TRACKS = (
    "array<struct<codec: string, handler: string, timescale: long, duration: long, samples: long, "
    "key_ranges: array<struct<begin: long, end: long>>>>"
)

def described(track: Track) -> dict:
    """The fields of one track in ``TRACKS``; ``key_ranges`` as rows of begin and end."""
    return {
        "codec": track.codec,
        "handler": track.handler,
        "timescale": track.timescale,
        "duration": None if track.duration == _UNKNOWN else track.duration,
        "samples": len(track.sizes),
        "key_ranges": track.key_ranges(),
    }


def _bounds(lists: list) -> pa.Array:
    return pa.array(np.cumsum([0, *(len(x) for x in lists)]), pa.int32())


def track_column(found: list[list[dict] | None]) -> pa.ListArray:
    """Described tracks of many containers as a column of type ``TRACKS``."""
    flat = [t for own in found for t in own or []]
    ranges = np.concatenate([np.zeros((0, 2), np.int64), *(t["key_ranges"] for t in flat)])
    pairs = pa.StructArray.from_arrays([pa.array(ranges[:, 0]), pa.array(ranges[:, 1])], names=["begin", "end"])
    kinds = {"codec": pa.string(), "handler": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "samples": pa.int64()}
    fields = [pa.array([t[k] for t in flat], kind) for k, kind in kinds.items()]
    fields.append(pa.ListArray.from_arrays(_bounds([t["key_ranges"] for t in flat]), pairs))
    structs = pa.StructArray.from_arrays(fields, names=[*kinds, "key_ranges"])
    missing = pa.array([own is None for own in found], pa.bool_())
    return pa.ListArray.from_arrays(_bounds([own or [] for own in found]), structs, mask=missing)


def media_tracks(frame: DataFrame, column: str = "media") -> DataFrame:
    """``frame`` with ``tracks`` in place of the binary ``column``."""
    others = [c for c in frame.columns if c != column]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, column):
                found = [
                    None if raw is None else [described(t) for t in tracks(memoryview(raw))]
                    for raw in rows.column(column).to_pylist()
                ]
                columns = [*(rows.column(c) for c in others), track_column(found)]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "tracks"])

    schema = frame.select(*(F.col(f"`{c}`") for c in others)).schema
    return frame.mapInArrow(read, schema.add("tracks", DataType.fromDDL(TRACKS)))


def media_metadata(frame: DataFrame, column: str = "media") -> DataFrame:
    """``frame`` with one row a track in place of the binary ``column``: track (from 0), codec, handler, timescale, duration,
    samples and key_ranges. Null media and containers without tracks give no row. The payload isn't looked at."""
    others = [F.col(f"`{c}`") for c in frame.columns if c != column]
    told = media_tracks(frame, column).select(*others, F.posexplode("tracks").alias("track", "_told"))
    return told.select(*others, "track", "_told.*")


def feature(track: dict) -> str:
    """Codec, clock, length and keyframes of a described track as one line."""
    ranges, duration = track["key_ranges"], track["duration"]
    seconds = (duration or 0) / track["timescale"] if track["timescale"] else 0
    return (
        f"codec={track['codec']} handler={track['handler']} rate={track['timescale']} duration={duration}"
        f" seconds={seconds:.3f} samples={track['samples']} keyframes={len(ranges)}"
        f" ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    )


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of every text, as a binary column."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = [t.encode() for t in whole_texts(rows.column("text")).to_pylist()]
                media = pa.array([container(padded(t)) for t in texts], pa.binary())
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), sizes, media], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_bytes long, media binary")


DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks")
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    f"media_sha256 string, feature string, tracks {TRACKS}"
)


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored containers hold, from their tables and from the payload read back through them.

    The payloads of several tracks are taken one after the other, and their features are lines of one string.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", *DIGEST]
        for batch in batches:
            for rows in slices(batch, "media"):
                out, found = [], []
                for raw in rows.column("media").to_pylist():
                    if raw is None:
                        found.append(None)
                        out.append((None,) * (len(DIGEST) - 1))
                        continue
                    data = memoryview(raw)
                    own = tracks(data)
                    found.append([described(t) for t in own])
                    payload = b"".join(t.payload(data) for t in own)
                    out.append(
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-FRAME:]),
                            len(raw),
                            hashlib.sha256(raw).hexdigest(),
                            "\n".join(map(feature, found[-1])),
                        )
                    )
                if out:
                    columns = [rows.column("doc_id"), rows.column("n_bytes"), *map(pa.array, zip(*out, strict=True), KINDS)]
                    yield pa.RecordBatch.from_arrays([*columns, track_column(found)], names=names)

    return media.mapInArrow(read, DIGEST_SCHEMA)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Containers written to shared storage, read again and digested."""
    return media_digest(stored(stored_media(docs), "media"))
