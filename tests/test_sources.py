"""Streams, descriptors, packages and images from hand-built bytes."""

import random
import struct
import zlib
from hashlib import sha256, sha512

import numpy as np
import pyarrow as pa
import pytest

from platterlake.functions import columns, geometry, palettes, signatures, wheel, wire
from platterlake.functions.wire import Cursor, WireError, quiet_filler, read_varuint, write_varuint
from platterlake.sources import descriptors, images, packages, streams
from platterlake.streaming import ingest


def text(t):
    return struct.pack(">H", len(t.encode())) + t.encode()


def chunk(payload, crc=None):
    return write_varuint(len(payload)) + struct.pack(">I", zlib.crc32(payload) if crc is None else crc) + payload


def stream(lengths=(4, 4, 4, 4, 4), tracks=(("One", 0, 2), ("Two", 3, 2)), gaps=((2, 1, 0),), samples=64_000, cut=None, tail=b"", crc=None):
    meta = bytes([2, 4 | (8 if gaps else 0), 1, 1, 31]) + text("ECDC") + struct.pack(">IBIIII", 48_000, 2, samples + 10, 5, samples, 2) + b"{}"
    meta += struct.pack(">H", len(lengths)) + b"".join(map(write_varuint, lengths))
    meta += struct.pack(">H", len(tracks)) + b"".join(text(t) + write_varuint(a) + write_varuint(n) for t, a, n in tracks)
    if gaps:
        meta += struct.pack(">H", len(gaps)) + b"".join(b"".join(map(write_varuint, g)) for g in gaps)
    meta += tail
    payload = bytes(range(sum(lengths)))
    sizes = cut or lengths
    at, parts = 0, []
    for n in sizes:
        parts.append(chunk(payload[at : at + n], crc))
        at += n
    return b"BRS1" + struct.pack(">I", len(meta)) + meta + b"".join(parts)


def segment(kind, payload):
    return struct.pack(">BH", kind, len(payload)) + payload


def descriptor(extra=(), stream_len=100, version=4, profile=1, crc=None, encoding=0):
    parts = [(1, bytes(4)), (2, struct.pack(">I", stream_len)), (4, bytes([profile])), (7, bytes([encoding])), *extra]
    body = b"".join(segment(*p) for p in parts)
    head = b"BRD1" + struct.pack(">BHHHdHd", version, 29 + len(body), len(parts), len(body), 0.4, 113, 0.9)
    data = head + body
    return data[:32] + struct.pack(">I", zlib.crc32(data) if crc is None else crc) + data[36:]


def package(*sections):
    header = 24 + 52 * len(sections)
    at, directory = header, b""
    for k, s in enumerate(sections):
        directory += struct.pack(">BBHQQ", k + 1, 0, 0, at, len(s)) + sha256(s).digest()
        at += len(s)
    head = b"BPK1" + struct.pack(">BBHIQ", 1, len(sections) - 2, len(sections), header, at)
    return head + struct.pack(">I", zlib.crc32(head + bytes(4) + directory)) + directory + b"".join(sections)


def files(spark, *rows):
    return spark.createDataFrame([(f"f{i}", None if r is None else bytearray(r)) for i, r in enumerate(rows)], "path string, content binary")


def test_varuint():
    for v in (0, 1, 127, 128, 300, 2**32, 2**64 - 1):
        assert read_varuint(write_varuint(v), 0, "v") == (v, len(write_varuint(v)))
    for bad in (b"", b"\x80", b"\x80\x00", b"\xff" * 10, b"\xff" * 9 + b"\x02"):
        with pytest.raises(WireError):
            read_varuint(bad, 0, "v")
    with pytest.raises(WireError):
        Cursor(b"\x00\x02a\x07").text("t")


def test_streams_to_tables(spark):
    good = stream()
    bad = [stream(tail=b"x"), stream(crc=7), good[:-1], b"BRS2" + good[4:], None, stream(lengths=(4, 0)), stream(gaps=((2, 1, 5),))]
    found = streams.parsed(files(spark, good, stream(cut=(6, 2, 4, 4, 4)), stream(tracks=(("One", 0, 2), ("Two", 1, 2)), gaps=()), *bad)).cache()
    assert [r.error is None for r in found.orderBy("path").collect()] == [True] * 3 + [False] * len(bad)
    assert [(r.idx, r.byte_offset) for r in streams.entries(found).where("path = 'f0'").orderBy("idx").collect()] == [(0, 0), (1, 4), (2, 8), (3, 12), (4, 16)]
    got = [(r.kind, r.number, r.title, r.start_sample, r.end_sample) for r in streams.regions(found).where("path = 'f0'").orderBy("ord").collect()]
    assert got == [("track", 1, "One", 0, 128_000), ("gap", 1, None, 128_000, 192_000), ("track", 2, "Two", 192_000, 320_000)]
    assert [(r.path, r.idx) for r in streams.chunks_outside(found).collect()] == [("f1", 0)]
    assert sorted((r.path, r.first_rev, r.rev_count, r.times) for r in streams.uncovered(found).collect()) == [("f2", 1, 1, 2), ("f2", 3, 2, 0)]
    one = streams.summary(found).where("path = 'f0'").first()
    assert (one.n_entries, one.payload_bytes, one.total_samples) == (5, 20, 320_000)
    assert bytes(streams.entries(found).where("path = 'f0' and idx = 1").first().sha256) == sha256(bytes(range(4, 8))).digest()


def test_gap_payload():
    body = quiet_filler(5, 30)
    data = b"GAP1" + bytes([1, 0, 0, 0]) + struct.pack(">QQI", 960, 58, 5) + body
    assert streams.gap_samples(data) == 960 and set(body) <= set(range(122, 135))
    for bad in (data[:-1], data[:-1] + b"\x00", data[:8] + bytes(8) + data[16:]):
        with pytest.raises(WireError):
            streams.gap_samples(bad)


def envelope(key=b"k", digest=bytes(32)):
    return bytes([2]) + digest + struct.pack(">H", len(key)) + key + bytes(64)


def test_descriptors(spark):
    isrcs = struct.pack(">HH", 1, 0) + b"USRC17607839"
    rich = descriptor([(5, b"Title"), (6, b""), (16, envelope()), (23, b"secret!"), (27, isrcs), (28, b"036000291452"), (29, envelope(b"d")), (99, b"later"), (35, b"\x04"), (34, b"\x01")])
    bad = [descriptor(crc=1), descriptor(version=3), descriptor([(5, b"a"), (5, b"b")]), descriptor([(27, isrcs)]), descriptor([(16, envelope()), (31, b"\x00\x01" + struct.pack(">H", len(envelope())) + envelope())]), descriptor([(35, b"\x09")]), descriptor([(5, b"a\x07")]), descriptor(encoding=1), descriptor(profile=9), descriptor()[:-1]]
    found = descriptors.descriptors(files(spark, rich, *bad)).cache()
    rows = found.orderBy("path").collect()
    assert [r.error is None for r in rows] == [True] + [False] * len(bad)
    r = rows[0]
    assert (r.title, r.artist, r.record_profile, r.payload_encoding, r.upc, r.clockwise, r.lead_out_revision, r.b_value) == ("Title", None, "lp", "rgb", "036000291452", True, 4, 0.4)
    kept = {s.type: s.payload for s in descriptors.segments(found).collect()}
    assert kept[23] is None and bytes(kept[99]) == b"later"
    trusted = spark.createDataFrame([(bytearray(b"k"), True)], "key_id binary, trusted boolean")
    assert sorted((s.role, s.status) for s in descriptors.signature_status(found, trusted).collect()) == [("deferred", "untrusted"), ("release", "unverified")]


def test_verification(spark):
    def packed(point):
        z = pow(point[2], signatures.P - 2, signatures.P)
        return (point[1] * z % signatures.P | (point[0] * z % signatures.P & 1) << 255).to_bytes(32, "little")

    secret, nonce, digest = 12345, 67890, b"d" * 32
    public, r = packed(signatures._times(secret, signatures.BASE)), packed(signatures._times(nonce, signatures.BASE))
    h = int.from_bytes(sha512(r + public + digest).digest(), "little")
    good = r + ((nonce + h * secret) % signatures.ORDER).to_bytes(32, "little")
    signed = lambda key, sig: descriptor([(16, bytes([2]) + digest + struct.pack(">H", len(key)) + key + sig)])
    found = descriptors.descriptors(files(spark, signed(b"k", good), signed(b"k", good[:-1] + b"\x01"), signed(b"none", good), signed(b"old", good), signed(b"short", good), descriptor(), b"x"))
    keys = spark.createDataFrame([(bytearray(k), bytearray(p), t) for k, p, t in ((b"k", public, True), (b"old", public, False), (b"short", b"p", True))], "key_id binary, public_key binary, trusted boolean")
    got = sorted((r.path, r.status) for r in descriptors.verification(found, keys).collect())
    assert got == [("f0", "Verified"), ("f1", "Invalid"), ("f2", "UntrustedKey"), ("f3", "UntrustedKey"), ("f4", "Unsupported"), ("f5", "Missing")]


def test_packages(spark):
    s = stream()
    good = package(descriptor(stream_len=len(s)), s)
    bad = [good[:-1], good + b"x", package(descriptor(stream_len=5), s), good[:60] + b"\xff" + good[61:], package(descriptor(stream_len=len(s)), s, b"side")]
    found = packages.packages(files(spark, good, *bad)).cache()
    assert [r.error is None for r in found.orderBy("path").collect()] == [True] + [False] * len(bad)
    assert streams.regions(streams.parsed(packages.section(found, "BRS1"))).count() == 3
    assert packages.inspection(found).where("path = 'f0'").first().section_bytes[1] == len(s)


def test_profiles_and_walk(spark):
    table = {r.profile: (r.label_radius, r.inner_radius, r.outer_radius, r.lead_in_px) for r in geometry.profiles(spark).collect()}
    assert table == {"single45": (151, 177, 280, 6), "single45vintage": (138, 177, 280, 6), "ten": (114, 138, 279, 7), "lp": (95, 115, 281, 5)}
    assert abs(len(geometry.lead_in("lp")) * 6 // 8 - 2428) < 0.02 * 2428  # near the published capacity; README says more
    band = geometry.programme("lp", 1.2, 113)
    assert len(set(band)) == len(band) and all(113 < geometry.distance(p, 576) < 281 for p in band)
    steps = [max(abs(a // 576 - b // 576), abs(a % 576 - b % 576)) for a, b in zip(band, band[1:], strict=False)]
    assert sum(s == 1 for s in steps) > 0.99 * len(steps)  # the outer edge cuts the first turn into dashes
    mirrored = geometry.walk(576, 1.2, 281.0, 200.0, True)
    assert len(mirrored) > 100 and mirrored[0] == geometry.walk(576, 1.2, 281.0, 200.0)[0]


def png(image, colour, kind=0):
    """A PNG of (h, w, n) samples; one filter for all lines."""
    h, w, n = image.shape
    rows, raw = image.reshape(h, w * n).astype(int), bytearray()
    for y in range(h):
        raw.append(kind)
        for x in range(w * n):
            left, up = rows[y, x - n] if x >= n else 0, rows[y - 1, x] if y else 0
            corner = rows[y - 1, x - n] if y and x >= n else 0
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            raw.append((rows[y, x] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.PNG_MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(raw))) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png(kind, colour):
    n = images.SAMPLES[colour]
    image = np.random.default_rng(kind).integers(0, 256, (7, 9, n)).astype(np.uint8)
    got = images.pixels(png(image, colour, kind))
    assert (got[..., :3] == (image[..., :3] if n > 2 else image[..., :1])).all()
    assert (got[..., 3] == (image[..., -1] if n in (2, 4) else 255)).all()


def test_descriptor_scan(spark):
    data = descriptor([(5, b"Synthetic")])
    image = np.zeros((576, 576, 4), np.uint8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    bits = np.concatenate((bits, np.zeros(-len(bits) % 6, np.uint8))).reshape(-1, 6)
    level = bits @ np.array([32, 16, 8, 4, 2, 1])
    image.reshape(-1, 4)[np.array(geometry.lead_in("lp")[: len(level)])] = np.stack([level + 96] * 3 + [np.full(len(level), 255)], axis=1)
    raw = b"RAWRGBA\x00" + struct.pack("<II", 576, 576) + image.tobytes()
    found = images.record_descriptors(files(spark, png(image[:, :, :], 6), raw, b"no image", png(image[:9], 6)), raw_magic=b"RAWRGBA\x00").cache()
    assert [r.error is None for r in found.orderBy("path").collect()] == [True, True, False, False]
    assert {r.title for r in descriptors.descriptors(found.where("error is null")).collect()} == {"Synthetic"}
    band = geometry.lead_in("lp")
    with pytest.raises(WireError):
        images.band_bytes(image, band, 2000)
    rnd = random.Random(1).randbytes(300)
    px = np.frombuffer(rnd, np.uint8).reshape(-1, 3)
    image.reshape(-1, 4)[np.array(band[:100])] = np.concatenate([px, np.full((100, 1), 255, np.uint8)], axis=1)
    image.reshape(-1, 4)[band[100]] = 0
    assert images.direct_bytes(image, band, 299) == rnd[:299]


def drawn(data, extra, pixels_of):
    """A synthetic image: descriptor on the grey ladder, stream along the programme."""
    d = descriptor(extra, stream_len=len(data), encoding=1 if extra else 0)
    image = np.zeros((576, 576, 4), np.uint8)
    flat = image.reshape(-1, 4)
    bits = np.unpackbits(np.frombuffer(d, np.uint8))
    level = np.concatenate((bits, np.zeros(-len(bits) % 6, np.uint8))).reshape(-1, 6) @ np.array([32, 16, 8, 4, 2, 1])
    flat[np.array(geometry.lead_in("lp")[: len(level)])] = np.stack([level + 96] * 3 + [np.full(len(level), 255)], axis=1)
    px = pixels_of(data)
    band = geometry.programme("lp", 0.4, geometry.programme_floor("lp", 0))
    flat[np.array(band[: len(px)])] = np.column_stack((px, np.full(len(px), 255)))
    return png(image, 6)


def test_full_scan(spark):
    s = stream()
    direct = lambda d: np.frombuffer(d + bytes(-len(d) % 3), np.uint8).reshape(-1, 3)
    tone = palettes.Tone((90, 80, 70), 2, 8, "base")
    wire_map = bytes([1]) + struct.pack(">H", 1) + write_varuint(len(s)) + bytes([90, 80, 70, 2, 8, 0])

    def toned(d):
        c = palettes.palette(tone)[np.frombuffer(d, np.uint8)]
        return np.stack((c >> 16, c >> 8 & 255, c & 255), axis=1)

    found = images.record_streams(files(spark, drawn(s, (), direct), drawn(s, [(22, wire_map)], toned), drawn(s, [(22, wire_map)], direct))).cache()
    rows = found.orderBy("path").collect()
    assert [r.error for r in rows][:2] == [None, None] and rows[2].error
    assert [bytes(r.content) for r in rows[:2]] == [s, s]
    assert streams.regions(streams.parsed(found.where("error is null"))).count() == 6
    assert [geometry.programme_floor(n, 4) for n in ("single45", "single45vintage", "ten", "lp")] == [175, 175, 135, 113]


def test_digests(spark):
    rid, a, b = bytes(range(16)), bytes(32), bytes([7]) * 32
    df = spark.createDataFrame([(bytearray(rid), 3, bytearray(a), bytearray(b))], "r binary, i int, a binary, b binary")
    got = df.select(columns.revolution_digest(b"D", df.r, df.i, df.a).alias("x")).first().x
    assert bytes(got) == sha256(b"D" + rid + struct.pack(">I", 3) + a).digest()
    from pyspark.sql import functions as F

    whole = df.select(columns.release_digest(b"R", df.r, F.lit(1), F.lit(2), df.a, F.array("a", "b"), df.b).alias("x")).first().x
    assert bytes(whole) == sha256(b"R" + rid + bytes([1, 2]) + a + b + struct.pack(">I", 2) + a + b).digest()


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.brs").write_bytes(stream())
    (tmp_path / "in/b.brs").write_bytes(b"junk")
    for _ in range(2):
        q = ingest.keep(ingest.arriving(spark, str(tmp_path / "in"), "*.brs"), streams.parsed, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert streams.read_files(spark, str(tmp_path / "in"), "a*").count() == 1


def test_wire_text():
    with pytest.raises(WireError):
        wire.plain_text(b"\xff", "t")


def wheel_map(rings, turns, span, blend, bits, order, tones, switches):
    head = bytes([2, bits, order, blend, len(rings), *rings]) + b"".join(struct.pack(">H", t) for t in turns) + struct.pack(">HH", *span)
    return head + b"".join(bytes([*base, tol, *gap, gap_tol]) for (base, tol), (gap, gap_tol) in tones) + write_varuint(len(switches)) + b"".join(map(write_varuint, switches))


def slow_cell(w, index, pixel, side):
    """A pixel's cell, worked out for it alone."""
    import math

    def unit(salt):
        z = (index + salt) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return ((z ^ z >> 31) >> 11) / 2**53

    x, y = pixel % side, pixel // side
    angle = (math.pi / 2 - math.atan2(side / 2 - y, x - side / 2)) % (2 * math.pi)
    low, high = w.span[0] / 10_000, w.span[1] / 10_000
    across = min(max((math.hypot(x - side / 2, side / 2 - y) / (side / 2) - low) / (high - low), 0), 1) * len(w.rings)
    ring = min(int(across), len(w.rings) - 1)
    off = across - ring - 0.5
    if w.blend and unit(0xD1B54A32D192ED03) < abs(off):
        ring = min(max(ring + (1 if off > 0 else -1), 0), len(w.rings) - 1)
    n = w.rings[ring]
    along = (angle - w.turns[min(ring, len(w.turns) - 1)] / 36_000 * 2 * math.pi) % (2 * math.pi) / (2 * math.pi / n)
    slot = min(int(along), n - 1)
    off = along - slot - 0.5
    if w.blend and unit(0x9E3779B97F4A7C15) < abs(off):
        slot = (slot + (1 if off > 0 else -1)) % n
    return sum(w.rings[:ring]) + slot


@pytest.mark.parametrize("blend", [0, 1])
def test_wheel_round_trip(blend):
    rnd = random.Random(3 + blend)
    rings = (3, 4)
    tones = [(((rnd.randrange(60, 200),) * 3, 40), ((rnd.randrange(60, 200),) * 3, 40)) for _ in range(sum(rings))]
    data = wheel_map(rings, (100, 9000), (3000, 9000), blend, 12, 0, tones, (40, 95))
    w = wheel.read(data, 150)
    side, length = 64, 150
    pixels = np.array(rnd.sample(range(side * side), 100))
    found = wheel.cells(w, pixels, side)
    assert found.tolist() == [slow_cell(w, i, int(p), side) for i, p in enumerate(pixels)]
    payload = rnd.randbytes(length)
    bits = "".join(f"{b:08b}" for b in payload)
    rgba = np.full((100, 4), 255, np.uint8)
    for i in range(100):
        base, tolerance = tones[found[i]][40 <= i * 12 // 8 < 95]
        packed = int(palettes.palette(palettes.Tone(base, tolerance, 12, "base"))[int(bits[12 * i : 12 * i + 12], 2)])
        rgba[i, :3] = packed >> 16, packed >> 8 & 255, packed & 255
    assert wheel.payload(w, rgba, pixels, side, length) == payload
    for bad in (data + b"x", data[:-1], b"\x03" + data[1:], wheel_map(rings, (100, 36_000), (3000, 9000), 0, 12, 0, tones, ()), wheel_map(rings, (0, 0), (9000, 3000), 0, 12, 0, tones, ()), wheel_map(rings, (0, 0), (0, 9000), 0, 12, 0, tones, (5, 5)), wheel_map((1, 4), (0, 0), (0, 9000), 0, 12, 0, tones[:5], ())):
        with pytest.raises(WireError):
            wheel.read(bad, 150)
    with pytest.raises(WireError):
        wheel.read(data, 95)


def test_clear_colour_and_grey_bytes():
    def png(colour, rows, clear):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, colour, 0, 0, 0)) + part(b"tRNS", clear) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")

    assert images.png_pixels(png(2, bytes([0, 1, 2, 3, 1, 2, 4]), bytes([0, 1, 0, 2, 0, 3])))[0, :, 3].tolist() == [0, 255]
    assert images.png_pixels(png(0, bytes([0, 7, 8]), bytes([0, 8])))[0, :, 3].tolist() == [255, 0]
    grey = np.array([[5, 5, 5, 255], [6, 6, 6, 0], [7, 7, 7, 9]], np.uint8)
    assert images.grey_bytes(grey) == bytes([5, 7]) and images.grey_bytes(grey, 1) == bytes([5])
    for bad, n in ((grey, 3), (np.array([[1, 2, 3, 255]], np.uint8), None)):
        with pytest.raises(WireError):
            images.grey_bytes(bad, n)


def test_payload_as_an_image(spark):
    for n in (0, 1, 12, 13, 300):
        data = bytes(range(256)) * 2
        image = images.png_pixels(images.block_png(data[:n]))
        assert images.direct_bytes(image, tuple(range(image.shape[0] ** 2)), n) == data[:n]
        assert image.shape[0] == image.shape[1] and image.shape[0] % 2 == 0 and (image[..., 3] > 0).sum() == -(-n // 3)
    s = stream()
    direct = lambda d: np.frombuffer(d + bytes(-len(d) % 3), np.uint8).reshape(-1, 3)
    row = images.payload_blocks(files(spark, drawn(s, (), direct))).first()
    assert images.png_pixels(bytes(row.content))[..., :3].tobytes()[:20] == bytes(range(20))


def test_batches_are_bounded_by_their_nested_rows(monkeypatch):
    files = [(f"p{i}", None if i == 5 else b"" if i == 6 else stream((1,) * 120, (("T", 0, 120),), ())) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in files]), pa.array([b for _, b in files], pa.binary())], ["path", "content"])
    whole = list(streams.parsed_batches(iter([batch]), streams.parse, streams.ARROW))
    monkeypatch.setattr(streams, "BATCH_BYTES", 600 * streams.NESTED_BYTES)
    cut = list(streams.parsed_batches(iter([batch]), streams.parse, streams.ARROW))
    nested = [sum(len(r[k] or ()) for r in b.to_pylist() for k in streams._LISTS) for b in cut]
    # a stream has 120 entries, 120 chunks, a track and a descriptor: three reach the bound
    assert len(whole) == 1 and len(cut) > 10 and max(nested) <= 3 * 242
    assert [r for b in cut for r in b.to_pylist()] == whole[0].to_pylist() and whole[0].num_rows == 40
    assert list(streams.parsed_batches(iter([batch.slice(0, 0)]), streams.parse, streams.ARROW)) == []
