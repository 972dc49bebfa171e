"""Palettes of toned carriers: colours of one luma window in a total order, and their bytes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .wire import Cursor, WireError

#: Rec. 709 weights and chroma scales; names of the orders by wire code.
WEIGHTS, CHROMA_BLUE, CHROMA_RED = (0.2126, 0.7152, 0.0722), 1.8556, 1.5748
ORDERS = {0: "base", 1: "chroma"}
#: Palettes a worker keeps; one of 20 bits is 4 MB with its lookup table.
KEPT = 12


class Tone(NamedTuple):
    """What a palette follows from."""

    base: tuple[int, int, int]
    tolerance: int
    bits: int
    order: str


class Span(NamedTuple):
    """A tone over a run of bytes, with where it starts in bytes and pixels."""

    tone: Tone
    byte_offset: int
    byte_length: int
    pixel_offset: int
    pixel_count: int


def luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return WEIGHTS[0] * r + WEIGHTS[1] * g + WEIGHTS[2] * b


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero; luma is never negative."""
    whole = np.floor(x)
    return whole + (x - whole >= 0.5)


def _window(base: tuple[int, int, int], tolerance: int) -> np.ndarray:
    """(n, 3) colours whose rounded luma is within the tolerance of the base's, in order of colour."""
    target = _rounded(luma(*(np.float64(v) for v in base)))
    g, b = np.meshgrid(np.arange(256.0), np.arange(256.0), indexing="ij")
    found = []
    for r in range(256):
        near = np.abs(_rounded(luma(np.float64(r), g, b)) - target) <= tolerance
        pair = np.argwhere(near)
        found.append(np.column_stack((np.full(len(pair), r), pair)))
    return np.concatenate(found)


@lru_cache(maxsize=KEPT)
def palette(tone: Tone) -> np.ndarray:
    """The 2**bits nearest colours of a tone's window, packed as 24-bit numbers, in symbol order.

    Nearest is by squared distance from the base or by distance in chroma; equal
    distances go by colour, so the order is total.
    """
    if tone.order not in ORDERS.values() or not 1 <= tone.bits <= 24:
        raise WireError("tone has an unknown order or a number of bits out of range")
    colours, need = _window(tone.base, tone.tolerance), 1 << tone.bits
    if len(colours) < need:
        raise WireError(f"tone has {len(colours)} colours and needs {need}")
    r, g, b = colours.T.astype(np.float64)
    if tone.order == "base":
        far = (r - tone.base[0]) ** 2 + (g - tone.base[1]) ** 2 + (b - tone.base[2]) ** 2
    else:
        y, own = luma(r, g, b), luma(*(np.float64(v) for v in tone.base))
        blue = (b - y) / CHROMA_BLUE - (tone.base[2] - own) / CHROMA_BLUE
        red = (r - y) / CHROMA_RED - (tone.base[0] - own) / CHROMA_RED
        far = np.sqrt(blue * blue + red * red)
    edge = np.partition(far, need - 1)[need - 1]
    close = np.flatnonzero(far <= edge)
    first = close[np.argsort(far[close], kind="stable")][:need]  # the window is in order of colour
    return (colours[first, 0] << 16 | colours[first, 1] << 8 | colours[first, 2]).astype(np.int32)


@lru_cache(maxsize=KEPT)
def _lookup(tone: Tone) -> tuple[np.ndarray, np.ndarray]:
    colours = palette(tone)
    order = np.argsort(colours)
    return colours[order], order.astype(np.uint32)


def symbols(tone: Tone, rgba: np.ndarray) -> np.ndarray:
    """Symbols of (n, 4) pixels; a colour outside the palette is an error."""
    packed = rgba[:, 0].astype(np.int32) << 16 | rgba[:, 1].astype(np.int32) << 8 | rgba[:, 2]
    held, order = _lookup(tone)
    at = np.minimum(np.searchsorted(held, packed), len(held) - 1)
    if (held[at] != packed).any():
        raise WireError("a pixel is not in the palette")
    return order[at]


def unpacked(values: np.ndarray, bits: int, length: int) -> bytes:
    """The first ``length`` bytes of symbols written most significant bit first."""
    wide = np.unpackbits(values.astype(">u4")[:, None].view(np.uint8), axis=1)[:, 32 - bits :]
    data = np.packbits(wide.reshape(-1)[: length * 8]).tobytes()
    if len(data) < length or wide.size < length * 8:
        raise WireError("toned pixels hold fewer bytes than asked for")
    return data


def read_spans(data: bytes, total: int | None = None) -> list[Span]:
    """The tone spans of a carrier map; together they cover ``total`` bytes."""
    c = Cursor(data)
    if c.uint(1, "carrier map version") != 1:
        raise WireError("carrier map version is unknown")
    out, at_byte, at_pixel = [], 0, 0
    for k in range(c.uint(2, "span count")):
        length = c.varuint(f"span {k} length")
        base = tuple(c.take(3, f"span {k} base"))
        tolerance, bits, order = (c.uint(1, f"span {k}") for _ in range(3))
        if not length or not 1 <= bits <= 24 or order not in ORDERS:
            raise WireError(f"span {k} is empty or has an unknown form")
        pixels = -(-length * 8 // bits)
        out.append(Span(Tone(base, tolerance, bits, ORDERS[order]), at_byte, length, at_pixel, pixels))
        at_byte, at_pixel = at_byte + length, at_pixel + pixels
    c.end("carrier map")
    if not out or total is not None and at_byte != total:
        raise WireError("spans are none or do not cover the stream")
    return out


def toned_bytes(rgba: np.ndarray, spans: list[Span]) -> bytes:
    """Payload of a toned groove: each span's own pixels through its palette."""
    out = []
    for s in spans:
        px = rgba[s.pixel_offset : s.pixel_offset + s.pixel_count]
        if len(px) < s.pixel_count:
            raise WireError("groove is shorter than its tone spans")
        out.append(unpacked(symbols(s.tone, px), s.tone.bits, s.byte_length))
    return b"".join(out)
