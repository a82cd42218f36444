"""Media containers: exact round trips, foreign layouts, damage, and the digest against direct figures."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import media as M


@settings(deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = M.padded(data)
    assert len(payload) % 64 == 0 and payload[: len(data)] == data and 0 < len(payload) <= max(64, len(data) + 63)
    raw = M.container(payload)
    (track,) = M.tracks(memoryview(raw))
    assert track.payload(memoryview(raw)) == payload
    assert (track.codec, track.handler, track.duration, track.ticks) == ("raw", "soun", len(payload), len(payload))
    for a, b in track.key_ranges().tolist():
        assert raw[a:b] == payload[a - track.starts[0] :][:64]


def test_other_layouts():
    """64-bit sizes and offsets, several sizes a sample, two chunk runs out of order, no sync table, a box to the end."""
    samples = [b"abc", b"de", b"fghij", b"k"]
    body = b"JUNK" + b"".join(samples[2:]) + b"GAP" + b"".join(samples[:2])
    head = M.box(b"free", b"x") + struct.pack(">I4sQ", 1, b"skip", 20) + b"1234"

    def moov(base):
        table = M.box(
            b"stbl",
            M.full_box(b"stsd", struct.pack(">I", 1), M.box(b"avc1", bytes(8))),
            M.full_box(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 5)),
            M.full_box(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)),
            M.full_box(b"stsz", struct.pack(">II4I", 0, 4, 3, 2, 5, 1)),
            M.full_box(b"co64", struct.pack(">IQQ", 2, base + 4 + 6 + 3, base + 4)),
        )
        mdhd = M.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 35, 0, 0))
        return M.box(b"moov", M.box(b"trak", M.box(b"mdia", mdhd, M.box(b"minf", table))))

    base = len(head) + len(moov(0)) + 8
    raw = memoryview(head + moov(base) + struct.pack(">I4s", 0, b"mdat") + body)
    (track,) = M.tracks(raw)
    assert [bytes(raw[a : a + n]) for a, n in zip(track.starts, track.sizes)] == samples
    assert track.payload(raw) == b"abcdefghijk"
    assert (track.codec, track.timescale, track.duration, track.ticks) == ("avc1", 600, 35, 35)
    assert len(track.key_ranges()) == 4
    assert [k for _, k, _, _ in M.walk(raw)][:4] == [b"free", b"skip", b"moov", b"trak"]


@pytest.mark.parametrize("cut", [5, 100, 300, 640])
def test_damage_is_told(cut):
    with pytest.raises((ValueError, struct.error)):
        M.tracks(memoryview(M.container(bytes(640))[:cut]))


def test_digest(spark, awkward, awkward_rows, empty_docs):
    got = M.media_round_trip(awkward).collect()
    want = []
    for doc_id, text in awkward_rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    stored = {r.doc_id: (r.media_bytes, r.media_sha256, r.feature) for r in got}
    assert stored[2] == stored[3] and stored[2][1] == hashlib.sha256(M.container(bytes(64))).hexdigest()
    assert M.media_round_trip(empty_docs).collect() == []
    assert np.all([r.media_bytes > r.payload_bytes for r in got])


def two_tracks():
    """Sound and video in one file: two samples of sound, four of video with keyframes 1 and 3."""
    video, sound = [b"KEY1", b"d", b"KEY22", b"dd"], [b"so", b"und"]

    def trak(kind, codec, clock, duration, sizes, at, *keys):
        table = M.box(
            b"stbl",
            M.full_box(b"stsd", struct.pack(">I", 1), M.box(codec, bytes(8))),
            M.full_box(b"stts", struct.pack(">III", 1, len(sizes), duration // len(sizes))),
            M.full_box(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)),
            M.full_box(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
            M.full_box(b"stco", struct.pack(">II", 1, at)),
            *([M.full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))] if keys else []),
        )
        mdhd = M.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, clock, duration, 0, 0))
        hdlr = M.full_box(b"hdlr", bytes(4), kind, bytes(12), b"\0")
        return M.box(b"trak", M.box(b"mdia", mdhd, hdlr, M.box(b"minf", table)))

    def moov(at):
        sizes = [len(x) for x in sound]
        first = trak(b"soun", b"mp4a", 8000, 4000, sizes, at)
        return M.box(b"moov", first, trak(b"vide", b"avc1", 600, 1200, [len(x) for x in video], at + sum(sizes), 1, 3))

    return moov(len(moov(0)) + 8) + M.box(b"mdat", *sound, *video)


def test_tracks_as_columns(spark):
    """Every track's codec, clock and keyframe ranges are in the result; other columns and nulls are kept."""
    raw, text = two_tracks(), bytes(range(256)) * 12
    rows = [(1, bytearray(raw), "a"), (2, None, "b"), (3, bytearray(M.container(M.padded(text))), None)]
    got = M.media_tracks(spark.createDataFrame(rows, "k int, `the film` binary, note string"), "the film")
    assert got.columns == ["k", "note", "tracks"]
    found = {r.k: r for r in got.collect()}
    assert found[2].tracks is None and [found[k].note for k in (1, 2, 3)] == ["a", "b", None]
    sound, video = found[1].tracks
    assert (sound.codec, sound.handler, sound.timescale, sound.duration, sound.samples) == ("mp4a", "soun", 8000, 4000, 2)
    assert (video.codec, video.handler, video.timescale, video.duration, video.samples) == ("avc1", "vide", 600, 1200, 4)
    assert [raw[a:b] for a, b in sound.key_ranges] == [b"so", b"und"]
    assert [raw[a:b] for a, b in video.key_ranges] == [b"KEY1", b"KEY22"]
    (only,) = found[3].tracks
    assert [rows[2][1][a:b] for a, b in only.key_ranges] == [text[i : i + 64] for i in range(0, len(text), 1024)]
    assert M.media_tracks(spark.createDataFrame([], "media binary")).collect() == []


def test_digest_of_several_tracks(spark):
    raw = two_tracks()
    (got,) = M.media_digest(spark.createDataFrame([(1, 17, bytearray(raw))], "doc_id long, n_bytes long, media binary")).collect()
    assert got.payload_sha256 == hashlib.sha256(b"soundKEY1dKEY22dd").hexdigest()
    assert [line.split()[0] for line in got.feature.split("\n")] == ["codec=mp4a", "codec=avc1"]
    for line, track in zip(got.feature.split("\n"), got.tracks, strict=True):
        packed = b"".join(struct.pack("<qq", a, b) for a, b in track.key_ranges)
        assert line.endswith(f"keyframes={len(track.key_ranges)} ranges={zlib.crc32(packed):08x}")


def test_fragments_are_refused():
    with pytest.raises(ValueError, match="fragmented"):
        M.tracks(memoryview(M.container(bytes(64)) + M.box(b"moof", M.box(b"traf"))))


def test_a_changed_byte_gives_nothing_but_value_errors():
    """Every byte in front of the payload set to other values; what is still read stays within the file."""
    whole = M.container(M.padded(b"some payload " * 200))
    head = whole.index(b"mdat") + 4
    told = 0
    for i in range(head):
        for value in (0, 1, 0x7F, 0xFF, whole[i] ^ 1):
            data = bytearray(whole)
            data[i] = value
            try:
                found = M.tracks(memoryview(bytes(data)))
            except ValueError:
                told += 1
                continue
            for t in found:
                assert len(t.sizes) <= len(whole) and len(t.payload(memoryview(bytes(data)))) <= len(whole)
                assert (t.key_ranges() >= 0).all() and (t.key_ranges() <= len(whole)).all()
                M.track_column([[M.described(t)]])
    assert told > head / 2


def test_every_cut_is_told_as_value_error_or_read():
    whole = M.container(M.padded(b"x" * 300))
    for n in range(len(whole)):
        try:
            M.tracks(memoryview(whole[:n]))
        except ValueError:
            pass


def test_null_media_and_metadata(spark):
    media = M.container(M.padded(b"abc" * 1000))
    rows = [(1, 3000, media, "x"), (2, 0, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, codec string")
    got = {r.doc_id: r for r in M.media_digest(df).collect()}
    assert got[2].payload_bytes is None and got[2].tracks is None and got[2].feature is None and got[1].payload_bytes == 3008
    (one,) = M.media_metadata(df.drop("codec")).collect()
    (track,) = M.tracks(memoryview(media))
    assert (one.doc_id, one.track, one.codec, one.duration, one.samples) == (1, 0, "raw", 3008, 47)
    assert [tuple(r) for r in one.key_ranges] == [tuple(r) for r in track.key_ranges().tolist()]


def test_features_match_a_plain_walk():
    """Codec, clock and keyframes by struct and loops over the boxes, without the module's tables."""
    import zlib

    payload = M.padded(bytes(range(256)) * 23)
    data = M.container(payload)
    found = {}

    def into(a, b):
        while a < b:
            n, kind = struct.unpack_from(">I4s", data, a)
            found[kind] = data[a + 8 : a + n]
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                into(a + 8, a + n)
            a += n

    into(0, len(data))
    size, n = struct.unpack_from(">II", found[b"stsz"], 4)
    offsets = struct.unpack_from(f">{struct.unpack_from('>I', found[b'stco'], 4)[0]}I", found[b"stco"], 8)
    runs = [struct.unpack_from(">III", found[b"stsc"], 8 + 12 * i) for i in range(struct.unpack_from(">I", found[b"stsc"], 4)[0])]
    starts = []
    for chunk, at in enumerate(offsets, 1):
        per = [r[1] for r in runs if r[0] <= chunk][-1]
        starts += [at + size * k for k in range(per)]
    keys = struct.unpack_from(f">{struct.unpack_from('>I', found[b'stss'], 4)[0]}I", found[b"stss"], 8)
    ranges = [(starts[k - 1], starts[k - 1] + size) for k in keys]
    rate, duration = struct.unpack_from(">IQ", found[b"mdhd"], 20)
    crc = zlib.crc32(b"".join(struct.pack("<qq", *r) for r in ranges))
    want = (
        f"codec={found[b'stsd'][12:16].decode().strip()} handler={found[b'hdlr'][8:12].decode()} rate={rate} duration={duration}"
        f" seconds={duration / rate:.3f} samples={n} keyframes={len(keys)} ranges={crc:08x}"
    )
    (track,) = M.tracks(memoryview(data))
    assert M.feature(M.described(track)) == want
