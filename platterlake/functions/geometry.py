"""Carrier geometry: the profiles and the walk along the groove.

The walk adds up a step for each pixel and rounds it, so it follows the platform's
own ``math`` functions one after the other; a vectorised sine or a running sum
would move pixels. Walks are cached by worker under all that determines them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Diameters in millimetres (finished, margin, recorded outside and inside, label).
MILLIMETRES = {
    "single45": (174.6, 172.2, 168.3, 107.95, 92.1),
    "single45vintage": (174.6, 172.2, 168.3, 107.95, 84.0),
    "ten": (250.825, 247.0, 241.3, 120.65, 100.0),
    "lp": (301.6, 297.6, 292.1, 120.65, 100.0),
}
#: Wire codes of the profiles.
CODES = {"single45": 0, "lp": 1, "ten": 2, "single45vintage": 3}
#: Fixed value: the least pitch of a spiral.
LEAST_PITCH = 1e-7
SIDE, RIM_PX, LEAD_IN_TURNS, START_ANGLE = 576, 287, 2.0, math.pi / 2
#: Fixed values of the pressed lead-out: least pitch and the lock's radius in millimetres.
LEAST_LEAD_OUT_MM, LOCK_7_MM, LOCK_10_12_MM = 3.2, 48.2, 52.8


def round_half_up(x: float) -> int:
    """floor(x + 0.5), the rounding of pixels."""
    return math.floor(x + 0.5)


def round_half_away(x: float) -> int:
    """The rounding of radii."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


class Profile(NamedTuple):
    """One row of the dimension table, in pixels of a 576-pixel record."""

    name: str
    code: int
    px_per_mm: float
    label_radius: int
    inner_radius: int
    outer_radius: int
    lead_in_px: int
    lock_radius: float


@lru_cache
def profile(name: str) -> Profile:
    """The geometry of a profile, by name."""
    key = name.strip()
    if key not in MILLIMETRES:
        raise ValueError(f"unknown record profile {name!r}")
    finished, margin, outer, inner, label = MILLIMETRES[key]
    scale = RIM_PX / (finished / 2)
    margin_px, outer_px, inner_px, label_px = (round_half_away(mm / 2 * scale) for mm in (margin, outer, inner, label))
    lead_in_px = margin_px - outer_px  # laid inward from a pixel inside the rim
    lock = (LOCK_7_MM if key.startswith("single45") else LOCK_10_12_MM) * scale
    return Profile(key, CODES[key], scale, label_px, inner_px, RIM_PX - 1 - lead_in_px, lead_in_px, lock)


def programme_floor(name: str, revision: int) -> int:
    """The radius the programme stays outside of: the lock, the least lead-out, two silent turns of two pixels."""
    p = profile(name)
    if revision >= 4:
        return math.ceil(p.lock_radius + LEAST_LEAD_OUT_MM * p.px_per_mm + 4.0 + 2.0)
    return math.ceil(p.label_radius + p.px_per_mm + 5.0 + 4.0)


def profiles(spark: SparkSession) -> DataFrame:
    """The four profiles, to be broadcast against records, with the floor of their programme in the current and the first revision."""
    rows = [(*profile(n), programme_floor(n, 4), programme_floor(n, 1)) for n in MILLIMETRES]
    return spark.createDataFrame(rows, "profile string, code int, px_per_mm double, label_radius int, inner_radius int, outer_radius int, lead_in_px int, lock_radius double, floor_radius int, first_floor_radius int")


def turns(inner: Column, outer: Column, pitch: Column) -> Column:
    """Turns of a band at a pitch; ``pitch`` is the spiral's b, a turn is 2 pi b wide."""
    return (outer - inner) / (2 * math.pi * pitch)


def overridden(label: Column, clearance: Column, outer: Column, least_clearance: int) -> Column:
    """struct<label_radius, inner_radius, outer_radius> of a profile's radii or what a caller sets instead; null if the bands do not fit."""
    inner = label + clearance
    good = (label >= 1) & (clearance >= least_clearance) & (inner < outer)
    return F.when(good, F.struct(label.cast("int").alias("label_radius"), inner.cast("int").alias("inner_radius"), outer.cast("int").alias("outer_radius")))


def turn_width(pitch: Column) -> Column:
    """Pixels between neighbouring turns."""
    return 2 * math.pi * pitch


def pitch_for_turns(inner: Column, outer: Column, n: Column) -> Column:
    """The pitch at which a band holds so many turns, or null for none or fewer."""
    return F.when(n > 0, F.greatest(F.greatest(outer - inner, F.lit(0.0)) / (2 * math.pi * n), F.lit(LEAST_PITCH)))


def cut_inner_radius(inner: Column, outer: Column, floor_radius: Column, fraction: Column) -> Column:
    """The radius at which a cut of a share of the band is laid out to stop; null for a share outside 0 to 1."""
    low = F.greatest(F.least(floor_radius, inner), F.lit(1)).cast("double")
    stop = F.floor(outer - F.greatest(outer - low, F.lit(0.0)) * fraction + 0.5)
    return F.when((fraction > 0) & (fraction <= 1), F.greatest(stop, F.ceil(low))).cast("int")


def chained(pixels: Iterable[int], width: int) -> list[int]:
    """A walk without the corners whose neighbours touch each other already."""
    kept: list[int] = []
    for p in pixels:
        kept.append(p)
        while len(kept) > 2:
            dy, dx = abs(kept[-3] // width - p // width), abs(kept[-3] % width - p % width)
            if max(dx, dy) > 1:
                break
            del kept[-2]
    return kept


@lru_cache(maxsize=16)
def walk(side: int, pitch: float, outer: float, inner: float, clockwise: bool = False, start_angle: float = START_ANGLE) -> tuple[int, ...]:
    """Pixels of an Archimedean groove in order, each once, from the outside in."""
    centre, top = side / 2, min(outer, side / 2 - 1)
    low, turn = max(inner, 0.0), -1.0 if clockwise else 1.0
    seen, found = set(), []
    swept, radius, angle = 0.0, top, start_angle
    while radius >= low:
        x, y = round_half_up(centre + radius * math.cos(angle)), round_half_up(centre - radius * math.sin(angle))
        if 0 <= x < side and 0 <= y < side and (at := y * side + x) not in seen:
            seen.add(at)
            found.append(at)
        swept += 1.0 / max(math.sqrt(radius * radius + pitch * pitch), 1e-6)
        angle = start_angle + turn * swept
        radius = top - pitch * swept
    return tuple(chained(found, side))


def distance(pixel: int, side: int) -> float:
    x, y = pixel % side - side / 2, pixel // side - side / 2
    return math.sqrt(x * x + y * y)


@lru_cache(maxsize=8)
def lead_in(name: str, side: int = SIDE) -> tuple[int, ...]:
    """The descriptor's band at the rim: trimmed at both ends, whole in between."""
    p = profile(name)
    outer, inner = float(RIM_PX - 1), float(p.outer_radius)
    traced = walk(side, (outer - inner) / (2 * math.pi * LEAD_IN_TURNS), outer, inner)
    first = next((i for i, q in enumerate(traced) if distance(q, side) < outer), len(traced))
    last = next((i for i in range(len(traced), first, -1) if distance(traced[i - 1], side) > inner), first)
    return traced[first:last]


@lru_cache(maxsize=16)
def programme(name: str, pitch: float, floor_radius: int, clockwise: bool = False, side: int = SIDE) -> tuple[int, ...]:
    """The programme's band: every pixel of the walk between the floor and the outer radius."""
    outer = profile(name).outer_radius
    return tuple(q for q in walk(side, pitch, float(outer), 0.0, clockwise) if floor_radius < distance(q, side) < outer)
