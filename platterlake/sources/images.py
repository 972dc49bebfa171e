"""Image files of records: PNG and a raw container, and the descriptor band in their pixels."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import geometry, palettes, wheel
from ..functions.wire import WireError
from . import descriptors, streams

PNG_MAGIC, RAW_HEADER = b"\x89PNG\r\n\x1a\n", 16
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The grey ladder of the descriptor band, its lowest rung and bits a pixel.
LADDER, LADDER_BITS = 96, 6
#: Larger images are refused before they are unpacked.
MOST_PIXELS = 1 << 26


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines of a PNG without their filters."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        row = out[y + 1]
        if kind == 0:
            row[:] = line
        elif kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            row[:] = line + above
        elif kind in (3, 4):
            cells, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(stride):
                left = cells[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - step] if x >= step else 0
                    guess = min(((abs(up[x] - corner), 0, left), (abs(left - corner), 1, up[x]), (abs(left + up[x] - 2 * corner), 2, corner)))[2]
                cells[x] = (cells[x] + guess) & 255
            row[:] = np.frombuffer(bytes(cells), np.uint8)
        else:
            raise WireError(f"PNG filter {kind} is unknown")
    return out[1:]


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 4) of a PNG with 8-bit samples, not interlaced."""
    at, header, body, palette, clear = len(PNG_MAGIC), b"", [], b"", b""
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise WireError("PNG chunk is truncated or its CRC is wrong")
        header = part if kind == b"IHDR" else header
        palette = part if kind == b"PLTE" else palette
        clear = part if kind == b"tRNS" else clear
        body += [part] if kind == b"IDAT" else []
        at += 12 + size
    if len(header) != 13:
        raise WireError("PNG has no header")
    width, height = (int.from_bytes(header[i : i + 4], "big") for i in (0, 4))
    depth, colour, interlaced = header[8], header[9], header[12]
    if depth != 8 or interlaced or colour not in SAMPLES or not 0 < width * height <= MOST_PIXELS:
        raise WireError("PNG is not an 8-bit, plain image of a sensible size")
    n = SAMPLES[colour]
    try:
        unpacker = zlib.decompressobj()
        raw = unpacker.decompress(b"".join(body), height * (width * n + 1))
    except zlib.error as e:
        raise WireError("PNG data does not unpack") from e
    if len(raw) != height * (width * n + 1):
        raise WireError("PNG data is too short")
    px = _unfilter(raw, height, width * n, n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        if px.max(initial=0) >= len(table):
            raise WireError("PNG pixel is outside the palette")
        out[..., :3], out[..., 3] = table[px[..., 0]], alpha[px[..., 0]]
    else:
        out[..., :3] = px[..., :3] if n > 2 else px[..., :1]
        if n in (2, 4):
            out[..., 3] = px[..., -1]
        elif len(clear) == 2 * n:  # one colour is clear; samples are stated in 16 bits
            out[..., 3] = np.where((px == np.frombuffer(clear, ">u2")).all(axis=-1), 0, 255)
    return out


def raw_pixels(data: bytes, magic: bytes) -> np.ndarray:
    """(height, width, 4) of the raw container: magic, two little-endian sizes, pixels."""
    width, height = (int.from_bytes(data[i : i + 4], "little") for i in (8, 12))
    if data[:8] != magic or len(data) != RAW_HEADER + 4 * width * height:
        raise WireError("raw image length does not fit its sizes")
    return np.frombuffer(data, np.uint8, offset=RAW_HEADER).reshape(height, width, 4)


def pixels(data: bytes, raw_magic: bytes | None = None) -> np.ndarray:
    if data.startswith(PNG_MAGIC):
        return png_pixels(data)
    if raw_magic and data.startswith(raw_magic):
        return raw_pixels(data, raw_magic)
    raise WireError("image is neither PNG nor raw")


def band_bytes(image: np.ndarray, band: tuple[int, ...], length: int) -> bytes:
    """Bytes of the grey ladder along a band; a pixel off the ladder is an error."""
    need = -(-length * 8 // LADDER_BITS)
    if len(band) < need:
        raise WireError("band is too short for the descriptor")
    px = image.reshape(-1, 4)[np.array(band[:need])]
    level = px[:, 0].astype(np.int16) - LADDER
    if (px[:, 3] == 0).any() or (px[:, :3] != px[:, :1]).any() or (level < 0).any() or (level >= 1 << LADDER_BITS).any():
        raise WireError("band has a pixel off the grey ladder")
    bits = np.unpackbits(level.astype(np.uint8)[:, None], axis=1)[:, 8 - LADDER_BITS :].reshape(-1)
    return np.packbits(bits[: length * 8]).tobytes()


def descriptor_bytes(image: np.ndarray, profile: str) -> bytes:
    """The descriptor in a record's lead-in; one that runs over into the trailer is not read."""
    band = geometry.lead_in(profile, image.shape[1])
    prefix = band_bytes(image, band, descriptors.PREFIX)
    if prefix[:4] != descriptors.MAGIC:
        raise WireError("lead-in holds no descriptor")
    return band_bytes(image, band, int.from_bytes(prefix[5:7], "big"))


def find_descriptor(data: bytes, raw_magic: bytes | None = None, profile: str | None = None) -> bytes:
    """The descriptor of a profile, or of the first profile whose lead-in parses and names that profile."""
    image = pixels(data, raw_magic)
    if image.shape[0] != image.shape[1]:
        raise WireError("record image is not square")
    if profile is not None and profile.strip() not in geometry.MILLIMETRES:
        raise WireError(f"profile {profile} is unknown")
    why = WireError("no profile fits")
    for name in [profile.strip()] if profile else geometry.MILLIMETRES:
        try:
            found = descriptor_bytes(image, name)
            if (named := descriptors.parse(found)["record_profile"]) == name:
                return found
            why = WireError(f"descriptor names {named}, not {name}")
        except WireError as e:
            why = e
    raise why


def grey_bytes(rgba: np.ndarray, length: int | None = None) -> bytes:
    """A byte for each grey pixel of (n, 4) that is not clear, up to a length."""
    shown = rgba[rgba[:, 3] > 0]
    if (shown[:, :3] != shown[:, :1]).any():
        raise WireError("a pixel is not grey")
    if length is not None and length > len(shown):
        raise WireError("image holds fewer bytes than asked for")
    return shown[:length, 0].tobytes()


def block_png(data: bytes) -> bytes:
    """Bytes as a square PNG of even side, three a pixel; what is left of the square is clear."""
    px = np.zeros((-(-len(data) // 3), 4), np.uint8)
    px[:, :3] = np.frombuffer(data + bytes(-len(data) % 3), np.uint8).reshape(-1, 3)
    px[:, 3] = 255
    side = max(2, math.isqrt(max(len(px) - 1, 0)) + 1)
    side += side % 2
    image = np.zeros((side * side, 4), np.uint8)
    image[: len(px)] = px
    rows = np.concatenate((np.zeros((side, 1), np.uint8), image.reshape(side, side * 4)), axis=1)
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return PNG_MAGIC + part(b"IHDR", side.to_bytes(4, "big") * 2 + bytes([8, 6, 0, 0, 0])) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def payload_blocks(files: DataFrame, path: str = "path", content: str = "content", raw_magic: bytes | None = None, profile: str | None = None) -> DataFrame:
    """(path, content, error): the payload of each record's stream as a plain image, an encrypted one's left out."""

    def block(data: bytes) -> bytes:
        stream = stream_bytes(data, raw_magic, profile)
        found = streams.parse(stream)
        if found["encrypted"]:
            raise WireError("stream is encrypted")
        return block_png(b"".join(stream[c["payload_start"] : c["payload_end"]] for c in found["chunks"]))

    return _extracted(files, path, content, block)


def direct_bytes(image: np.ndarray, band: tuple[int, ...], length: int) -> bytes:
    """Payload of the direct encoding: three bytes a pixel up to the first clear one."""
    data = lifted(image, band)[:, :3].tobytes()
    if len(data) < length:
        raise WireError("groove holds fewer bytes than the stream's length")
    return data[:length]


def lifted(image: np.ndarray, band: tuple[int, ...]) -> np.ndarray:
    """Pixels along a band up to the first clear one."""
    px = image.reshape(-1, 4)[np.array(band)]
    clear = np.flatnonzero(px[:, 3] == 0)
    return px[: clear[0] if len(clear) else len(px)]


def stream_bytes(data: bytes, raw_magic: bytes | None = None, profile: str | None = None, length: int | None = None) -> bytes:
    """The payload stream of a record image with a constant pitch: direct, toned by spans or toned by a wheel.

    ``profile`` and ``length``, where given, stand for what the descriptor would be
    looked up by and for the length that it states.
    """
    image, d = pixels(data, raw_magic), descriptors.parse(find_descriptor(data, raw_magic, profile))
    parts = {s["type"]: s["payload"] for s in d["segments"]}
    if 30 in parts:
        raise WireError("varied pitch is not read yet")
    floor = geometry.programme_floor(d["record_profile"], d["lead_out_revision"])
    band = geometry.programme(d["record_profile"], d["b_value"], floor, d["clockwise"], image.shape[1])
    stated, length = d["stream_byte_length"], length or d["stream_byte_length"]
    if d["payload_encoding"] == "rgb":
        return direct_bytes(image, band, length)
    groove = lifted(image, band)
    if d["payload_encoding"] == "toned-v2":
        return wheel.payload(wheel.read(parts[descriptors.WHEEL], stated), groove, np.array(band[: len(groove)]), image.shape[1], length)
    return palettes.toned_bytes(groove, palettes.read_spans(parts[descriptors.SPANS], stated))[:length]


def _extracted(files: DataFrame, path: str, content: str, extract: Callable[[bytes], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for data in batch.column(1):
                try:
                    found.append(extract(data.as_py() or b""))
                    errors.append(None)
                except WireError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select(path, content).mapInArrow(run, "path string, content binary, error string")


def record_descriptors(files: DataFrame, path: str = "path", content: str = "content", raw_magic: bytes | None = None, profile: str | None = None) -> DataFrame:
    """(path, content, error): each image's descriptor bytes, ready for their parser; the groove is not read."""
    return _extracted(files, path, content, lambda data: find_descriptor(data, raw_magic, profile))


def record_streams(files: DataFrame, path: str = "path", content: str = "content", raw_magic: bytes | None = None, profile: str | None = None, length: int | None = None) -> DataFrame:
    """(path, content, error): each image's payload stream, ready for its parser."""
    return _extracted(files, path, content, lambda data: stream_bytes(data, raw_magic, profile, length))
