"""Spans of regular expressions in SQL functions alone, in code points, in time linear in text and matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, m: string, g: string, before: string, after: string>>"
#: Elements that one walk gathers, and elements that are cut into such pieces at once.
_PIECE, _BLOCK = 64, 4096
#: Characters before a match that ``before`` holds at most.
REACH = 24


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(items: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.transform(at, lambda i: F.slice(items, i, F.lit(size)))


def running(items: Column, zero: int, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of ``out(state, x)`` for each element, where ``step(state, x)``, an int, is the next element's state.

    An array that grows in an aggregate is copied for each element. So one walk
    finds the states at which pieces of fixed size begin, and results are gathered
    within each piece.
    """
    start = F.lit(zero).cast("int")
    next_ = lambda s, x: step(s, x).cast("int")

    def gathered(part: Column, state: Column) -> Column:
        first = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("new"))
        one = lambda s, x: F.struct(next_(s["state"], x).alias("state"), F.array_append(s["new"], out(s["state"], x).cast(kind)).alias("new"))
        return F.aggregate(part, first, one, lambda s: s["new"])

    def walked(parts: Column) -> Column:
        states = F.aggregate(parts, F.array(start), lambda s, part: F.array_append(s, F.aggregate(part, F.element_at(s, -1), next_)))
        both = F.arrays_zip(parts.alias("part"), F.slice(states, 1, F.size(parts)).alias("state"))
        return F.flatten(F.transform(both, lambda x: gathered(x["part"], x["state"])))

    cut = let(items, lambda xs: F.flatten(F.transform(_pieces(xs, _BLOCK), lambda block: _pieces(block, _PIECE))))
    return let(cut, walked)


def matches(text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """array<struct<start, end, m, g, before, after>> of the leftmost non-overlapping matches.

    The text between matches (split) and the matches (extract all) alternate, so
    their lengths add up to the places. ``m`` is the match and ``g`` a group of it;
    ``before`` is what stands before it, ``REACH`` characters at most, from the
    match before it on; ``after`` is the character that follows it. ``keep(m, g)``
    drops matches without a retry. A null text has none. Patterns must not match
    the empty string; long repeats should be possessive, since the engine recurses
    for repeated groups otherwise.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rest = lambda xs, n: F.slice(xs, 2, F.greatest(n - 1, F.lit(0)))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), parts.alias("g"), F.concat(F.array(F.lit("")), found).alias("last"), rest(gaps, F.size(gaps)).alias("gap2"), rest(found, F.size(found)).alias("m2"))
    length = lambda x: F.coalesce(F.length(x["gap"]) + F.length(x["m"]), F.lit(0))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        before = F.right(F.concat(x["last"], x["gap"]), F.lit(REACH))
        after = F.left(F.concat(x["gap2"], F.coalesce(x["m2"], F.lit(""))), F.lit(1))
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["g"].alias("g"), before.alias("before"), after.alias("after"))

    real = F.filter(zipped, lambda x: x["m"].isNotNull())  # after the last match there is a gap alone
    spans = running(real, 0, lambda at, x: at + length(x), span, SPAN[6:-1])
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["m"], x["g"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end of array<struct<..., kind, start, end>>, comma-joined in array order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
