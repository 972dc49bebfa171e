"""Tone wheels: which palette a pixel of a groove is read with, by its place on the disc."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from . import palettes
from .wire import Cursor, WireError

#: Wire versions, limits and units of a wheel.
WEDGES, RINGS, MOST_RINGS, SLOTS, MOST_CELLS, WHOLE, FULL_TURN = 1, 2, 8, range(2, 65), 256, 10_000, 36_000
#: What is added to a groove index before the generator's finalizer, along and across the groove.
ALONG, ACROSS = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class Wheel(NamedTuple):
    """A wheel as its map states it; ``tones`` has a pair (track, gap) of (base, tolerance) for each cell."""

    rings: tuple[int, ...]
    turns: tuple[int, ...]
    span: tuple[int, int]
    blend: bool
    bits: int
    order: str
    tones: tuple[tuple[tuple[tuple[int, int, int], int], ...], ...]
    switches: tuple[int, ...]


def read(data: bytes, total: int | None = None) -> Wheel:
    """A wheel from its map, both versions; ``total`` is the stream's length, which switches stay below."""
    c = Cursor(data)
    if (version := c.uint(1, "wheel version")) not in (WEDGES, RINGS):
        raise WireError(f"wheel version {version} is unknown")
    bits, order, blend = c.uint(1, "wheel bits"), c.uint(1, "wheel order"), c.uint(1, "wheel blend")
    if order not in palettes.ORDERS or blend > 1 or not 1 <= bits <= 24:
        raise WireError("wheel order, blend or bits are out of range")
    if version == RINGS:
        n = c.uint(1, "ring count")
        rings = tuple(c.uint(1, "ring slots") for _ in range(n))
        turns = tuple(c.uint(2, "ring rotation") for _ in range(n))
        span = (c.uint(2, "band inside"), c.uint(2, "band outside"))
    else:
        turns, rings, span = (c.uint(2, "rotation"),), (c.uint(1, "slot count"),), (0, WHOLE)
    if not 1 <= len(rings) <= MOST_RINGS or any(r not in SLOTS for r in rings) or sum(rings) > MOST_CELLS:
        raise WireError("wheel has too many or too few rings or slots")
    if not span[0] < span[1] <= WHOLE or any(t >= FULL_TURN for t in turns):
        raise WireError("wheel band or rotation is out of range")
    tone = lambda: (tuple(c.take(3, "wheel tone")), c.uint(1, "wheel tolerance"))
    tones = tuple((tone(), tone()) for _ in range(sum(rings)))
    count = c.varuint("switch count")
    if count > c.left:
        raise WireError("wheel has fewer switches than it says")
    switches = tuple(c.varuint("switch") for _ in range(count))
    c.end("wheel")
    if any(b <= a for a, b in zip((0, *switches), switches, strict=False)) or total is not None and switches and switches[-1] >= total:
        raise WireError("wheel switches are not ascending within the stream")
    return Wheel(rings, turns, span, bool(blend), bits, palettes.ORDERS[order], tones, switches)


def draws(n: int, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each groove index below ``n``."""
    with np.errstate(over="ignore"):
        z = np.arange(n, dtype=np.uint64) + np.uint64(salt)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _stepped(at: np.ndarray, home: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the neighbour a pixel is blended into, the likelier the nearer it is to that side."""
    off = at - home - 0.5
    return np.where(draw < np.abs(off), np.sign(off), 0).astype(np.int64)


def cells(wheel: Wheel, pixels: np.ndarray, side: int) -> np.ndarray:
    """The cell of each pixel, given by its place on a square raster in the order of the groove."""
    half, tau = side / 2, 2 * math.pi
    x, y = (pixels % side).astype(float) - half, half - (pixels // side).astype(float)
    # the platform's own functions, one by one: an ulp can move a pixel to another cell
    angle = np.fromiter((math.pi / 2 - math.atan2(b, a) for a, b in zip(x.tolist(), y.tolist(), strict=True)), float, len(x)) % tau
    away = np.fromiter(map(math.hypot, x.tolist(), y.tolist()), float, len(x)) / half
    low, high = (v / WHOLE for v in wheel.span)
    n = len(wheel.rings)
    at = np.clip((away - low) / (high - low), 0.0, 1.0) * n
    ring = np.minimum(at.astype(np.int64), n - 1)
    if wheel.blend and n > 1:
        ring = np.clip(ring + _stepped(at, ring, draws(len(x), ACROSS)), 0, n - 1)
    counts, starts = np.array(wheel.rings), np.concatenate(([0], np.cumsum(wheel.rings)[:-1]))
    turns = np.array([wheel.turns[min(i, len(wheel.turns) - 1)] / FULL_TURN * tau for i in range(n)])
    place = ((angle - turns[ring]) % tau) / (tau / counts[ring])
    slot = np.minimum(place.astype(np.int64), counts[ring] - 1)
    if wheel.blend:
        slot = (slot + _stepped(place, slot, draws(len(x), ALONG))) % counts[ring]
    return starts[ring] + slot


def payload(wheel: Wheel, rgba: np.ndarray, pixels: np.ndarray, side: int, length: int) -> bytes:
    """Bytes of a groove: each pixel through the palette of its cell, of the track or of the gap it lies in."""
    need = -(-length * 8 // wheel.bits)
    if len(rgba) < need:
        raise WireError("groove is shorter than its stream")
    rgba, pixels = rgba[:need], pixels[:need]
    gap = np.searchsorted(np.array(wheel.switches, dtype=np.int64), np.arange(need) * wheel.bits // 8, side="right") % 2
    keys = cells(wheel, pixels, side) * 2 + gap
    out = np.zeros(need, np.uint32)
    for key in np.unique(keys):  # one palette at a time: each is megabytes
        base, tolerance = wheel.tones[key // 2][key % 2]
        own = keys == key
        out[own] = palettes.symbols(palettes.Tone(base, tolerance, wheel.bits, wheel.order), rgba[own])
    return palettes.unpacked(out, wheel.bits, length)
