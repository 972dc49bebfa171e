"""Time and budget arithmetic of programmes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import round_half_up

#: Seconds of a revolution by profile, and the limits of a gap.
REVOLUTION_SECONDS = {"single45": 4 / 3, "ten": 4 / 3, "lp": 9 / 5}
GAP_TURNS, MOST_GAP_SAMPLES, GAP_HEADER_BYTES, BYTES_A_PIXEL = (0.25, 8.0), 192_000 * 3_600, 28, 3


def revolution_seconds(profile: Column) -> Column:
    """Seconds of a turn, or null for a profile without a stated speed."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in REVOLUTION_SECONDS.items() for x in pair)), profile)


def gap_samples(seconds: Column, rate: Column) -> Column:
    """Samples of a gap, rounded half up; null outside 1 to the most a gap may have."""
    n = round_half_up(seconds * rate).cast("bigint")
    return F.when((seconds > 0) & (rate > 0) & n.between(1, MOST_GAP_SAMPLES), n)


def gap_turns(seconds: Column, profile: Column) -> Column:
    """Visible width of a gap in turns, between a quarter and eight."""
    turns = F.least(F.greatest(seconds / revolution_seconds(profile), F.lit(GAP_TURNS[0])), F.lit(GAP_TURNS[1]))
    return F.when((seconds > 0) & revolution_seconds(profile).isNotNull(), turns)


def gap_bytes(seconds: Column, profile: Column, pixels_a_turn: Column) -> Column:
    """Payload bytes of a gap of that width, its header at least."""
    pixels = F.round(gap_turns(seconds, profile) * pixels_a_turn)
    return F.when(pixels.isNotNull(), F.greatest(pixels * BYTES_A_PIXEL, F.lit(GAP_HEADER_BYTES)).cast("bigint"))


def whole_turns(samples: Column, stride: Column) -> Column:
    """Segments that samples fill, the last one perhaps in part."""
    return F.ceil(samples / F.greatest(stride, F.lit(1))).cast("bigint")


def segment_budget(tracks: DataFrame, keys: list[str], order: list[str], samples: str, gap_seconds: str, rate: int, stride: int) -> DataFrame:
    """(keys, order, track_segments, gap_samples, gap_segments, first_segment) of each track and the gap after it."""
    gap = F.when(F.col(gap_seconds) > 0, F.greatest(F.round(F.col(gap_seconds) * max(rate, 1)), F.lit(1))).otherwise(0).cast("bigint")
    each = tracks.select(*keys, *order, whole_turns(F.greatest(F.col(samples), F.lit(1)), F.lit(stride)).alias("track_segments"), gap.alias("gap_samples"))
    both = each.withColumn("gap_segments", whole_turns(F.col("gap_samples"), F.lit(stride)))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("first_segment", F.coalesce(F.sum(F.col("track_segments") + F.col("gap_segments")).over(before), F.lit(0)))
