"""Palettes, identifiers and signatures against definitions and published vectors."""

import struct

import numpy as np
import pytest

from platterlake.functions import identifiers, palettes, signatures
from platterlake.functions.wire import WireError, write_varuint


def slow_palette(tone):
    y = lambda c: 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]
    half_up = lambda v: int(v + 0.5)
    chroma = lambda c: ((c[2] - y(c)) / 1.8556, (c[0] - y(c)) / 1.5748)

    def far(c):
        if tone.order == "base":
            return sum((a - b) ** 2 for a, b in zip(c, tone.base, strict=True))
        (a, b), (p, q) = chroma(c), chroma(tone.base)
        return ((a - p) * (a - p) + (b - q) * (b - q)) ** 0.5

    near = [(r, g, b) for r in range(100) for g in range(100) for b in range(100) if abs(half_up(y((r, g, b))) - half_up(y(tone.base))) <= tone.tolerance]
    return sorted(near, key=lambda c: (round(far(c), 9), c))[: 1 << tone.bits]


@pytest.mark.parametrize("order", ["base", "chroma"])
def test_palette_is_the_nearest_in_total_order(order):
    tone = palettes.Tone((20, 24, 30), 1, 6, order)
    got = [(int(v) >> 16, int(v) >> 8 & 255, int(v) & 255) for v in palettes.palette(tone)]
    assert len(set(got)) == 64 and set(got) == set(slow_palette(tone))
    if order == "base":
        assert got == slow_palette(tone)


def test_toned_spans_round_trip():
    data = np.random.default_rng(2).integers(0, 256, 100).astype(np.uint8).tobytes()
    spans = [((90, 80, 70), 2, 10, 0, 37), ((40, 60, 90), 3, 7, 1, 63)]
    wire = bytes([1]) + struct.pack(">H", 2) + b"".join(write_varuint(n) + bytes([*base, tol, bits, order]) for base, tol, bits, order, n in spans)
    found = palettes.read_spans(wire, 100)
    assert [(s.byte_offset, s.pixel_count) for s in found] == [(0, 30), (37, 72)]
    rows = []
    for s in found:
        bits = np.unpackbits(np.frombuffer(data[s.byte_offset : s.byte_offset + s.byte_length], np.uint8))
        bits = np.concatenate((bits, np.zeros(-len(bits) % s.tone.bits, np.uint8))).reshape(-1, s.tone.bits)
        colour = palettes.palette(s.tone)[bits @ (1 << np.arange(s.tone.bits)[::-1])]
        rows.append(np.stack((colour >> 16, colour >> 8 & 255, colour & 255, np.full(len(colour), 255)), axis=1))
    image = np.concatenate(rows).astype(np.uint8)
    assert palettes.toned_bytes(image, found) == data
    image[0, :3] = 255
    with pytest.raises(WireError):
        palettes.toned_bytes(image, found)
    for bad in (wire[:-1], wire + b"x", b"\x02" + wire[1:]):
        with pytest.raises(WireError):
            palettes.read_spans(bad, 100)
    with pytest.raises(WireError):
        palettes.palette(palettes.Tone((0, 0, 0), 0, 20, "base"))


def test_identifiers(spark):
    data = bytes(range(100, 116))
    text = identifiers.from_bytes(data)
    assert identifiers.to_bytes(text) == data and len(text) == 30
    rows = spark.createDataFrame([(text,), ("key" + text[3:],), ("rel_8" + text[5:],), ("xyz" + text[3:],), ("rel",)], "t string")
    assert [r.k for r in rows.select(identifiers.kind(rows.t).alias("k")).collect()] == ["release", None, None, None, None]
    assert rows.select(identifiers.kind(rows.t, True).alias("k")).collect()[1].k == "key"
    weights = (1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
    code = identifiers.catalogue_code(data, b"domain", weights)
    assert identifiers.read_code(f"ab {identifiers.slug(code)}", weights, "AB") == code
    assert identifiers.read_code(code.replace("0", "o").replace("1", "l"), weights) == code
    wrong = ("1" if code[0] == "0" else "0") + code[1:]
    with pytest.raises(WireError):
        identifiers.read_code(wrong, weights)


def test_signatures(spark):
    # RFC 8032, section 7.1, tests 1 and 2
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    sig = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    key2 = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    sig2 = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    rows = [(key, b"", sig), (key2, b"\x72", sig2), (key, b"x", sig), (key2, b"", sig), (key[:31], b"", sig), (None, b"", sig)]
    df = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in rows], "k binary, m binary, s binary")
    assert [r.ok for r in df.select(signatures.verified(df.k, df.m, df.s).alias("ok")).collect()] == [True, True, False, False, False, False]
