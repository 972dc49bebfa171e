"""Sharding by a minimax contiguous partition, all in SQL functions.

The atoms are groups of equal texts (of equal 64-bit hash), which stay together.
They are ordered by that hash; groups larger than an eighth of an even share come
first, the largest foremost, so a giant does not break up the run of small ones.
The smallest feasible capacity is found by binary search; a probe jumps from cut to
cut, each as far as the capacity reaches. The cuts are then placed at that
capacity: each shard ends at the group nearest to the even share of what is left,
and if that would exceed the capacity anywhere, where the greedy walk ends it.

The search does not see all groups but at most some ``CELLS`` cells of neighbours,
with their bytes and largest group. Where a cut falls within a cell, both the
nearest and the farthest place that it can take are followed, which bounds the
capacity and each cut from both sides. The cells between these bounds are cut finer
by more bits of the hash, by a pass over their groups alone, until the bounds hold
single groups only. So the capacity is the smallest over all groups, however many
there are, and no task holds more than the cells.

Places within a shard are numbered without gathering a shard in one task: rows
of a shard fall into stacks by a hash of their id, stacks get offsets from their
counts, and rows are numbered within a stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import settle
from ._spans import let

#: Cells of a round: a table of fixed size, whatever the input.
CELLS = 65_536
STACKS = 1024
#: What a row costs besides its text.
ROW_BYTES = 8


def _place(x: Column) -> Column:
    """How many cells end at ``x`` or before."""
    first = F.struct(F.lit(0).alias("low"), F.size("cells").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.element_at("cells", mid + 1)["end"] <= x
        return F.when(s["low"] >= s["high"], s).when(right, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), first, halve)["low"]


def _cell(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the cell (start, end, top) that ``x`` falls into; top is 0 for a single group."""
    total = F.col("total")

    def made(i: Column) -> Column:
        own = F.try_element_at("cells", i + 1)
        start = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.try_element_at("cells", F.greatest(i, F.lit(1)))["end"])
        return F.struct(F.coalesce(start, total).alias("start"), F.coalesce(own["end"], total).alias("end"), F.coalesce(own["top"], F.lit(0)).alias("top"))

    return let(let(_place(x), made), f)


def _reach(x: Column, far: bool) -> Column:
    """The last end of a group at ``x`` or before: the farthest or the nearest that it can be."""
    return let(x, lambda x: _cell(x, lambda c: F.when(c["top"] == 0, c["start"]).otherwise(x if far else F.greatest(c["start"], x - c["top"] + 1))))


def _even(s: Column, left: Column, far: bool) -> Column:
    """The end of a group nearest to the even share of what is left after ``s``: the farthest or the nearest it can be."""
    rest = F.col("total") - s
    share = s + F.floor(rest / left).cast("bigint")

    def nearest(c: Column) -> Column:
        one = F.when(((c["start"] + c["end"] - 2 * s) * left > 2 * rest) & (c["start"] > s), c["start"]).otherwise(c["end"])
        # one more than the share's fraction, and the first group of a shard is in it however large
        many = F.least(c["end"], F.greatest(share, s) + c["top"] + 1) if far else F.greatest(c["start"], share - c["top"])
        return F.when(c["top"] == 0, one).otherwise(many)

    return let(share, lambda y: _cell(y, nearest))


def _walk(capacity: Column, shards: int, far: bool, even: bool = False) -> Column:
    """The bounds on one side of the ends of the first ``shards`` shards."""

    def step(ends: Column, left: Column) -> Column:
        s = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0).cast("bigint"))

        def end(s: Column) -> Column:
            full = _reach(s + capacity, far)
            return F.least(full, _even(s, left, far)) if even else full

        return F.array_append(ends, let(s, end))

    return F.aggregate(F.sequence(F.lit(shards), F.lit(2), F.lit(-1)), F.array().cast("array<bigint>"), step)


def _least_capacity(shards: int, far: bool) -> Column:
    """The smallest capacity at which the walk comes to the end with the last shard."""
    first = F.struct(F.col("low"), F.greatest("total", "low").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = s["low"] + F.floor((s["high"] - s["low"]) / 2).cast("bigint")

        def probe(mid: Column) -> Column:
            reached = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.lit(0).cast("bigint"), lambda at, _: F.when(at >= F.col("total"), at).otherwise(_reach(at + mid, far)))
            return F.when(reached >= F.col("total"), F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct((mid + 1).alias("low"), s["high"].alias("high")))

        return F.when(s["low"] >= s["high"], s).otherwise(let(mid, probe))

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), first, halve)["high"]


def _gathered(groups: DataFrame, shift: int) -> DataFrame:
    """(big, hash, shift, bytes, top): groups whose hashes agree but for the last ``shift`` bits as one cell."""
    cell = F.shiftleft(F.shiftright("hash", shift), shift).alias("hash")
    return groups.groupBy(F.lit(0).cast("bigint").alias("big"), cell).agg(F.lit(shift).alias("shift"), F.sum("bytes").alias("bytes"), F.when(F.count(F.lit(1)) == 1, 0).otherwise(F.max("bytes")).alias("top"))


def _is_large(total: int, shards: int) -> Column:
    """Whether a group has more than an eighth of an even share; there are fewer than 8 a shard."""
    return 8 * shards * F.col("bytes") > total


def plan(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, int, list[tuple[int, int]]]:
    """From (hash, bytes), a row for each group: all bytes, the capacity, and (-bytes, hash) of the first group of the second and later shards.

    Groups are in order of (-bytes, hash) with 0 for the bytes of all but the
    largest. ``groups`` is read once, and again for each finer cut of the cells.
    """
    whole = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    if whole.total is None or shards < 2:
        return whole.total or 0, whole.total or 0, []
    total, low = whole.total, max(whole.largest, -(-whole.total // shards))
    large = _is_large(total, shards)
    small = groups.where(~large)
    known = groups.where(large).select((-F.col("bytes")).alias("big"), "hash", F.lit(0).alias("shift"), "bytes", F.lit(0).cast("bigint").alias("top"))
    known = settle(known.unionByName(_gathered(small, 64 - (cells.bit_length() - 1))))
    while True:
        # a table of cells, so one task holds it
        order = Window.partitionBy(F.lit(0)).orderBy("big", "hash")
        placed = settle(known.withColumn("end", F.sum("bytes").over(order)))
        flat = placed.agg(F.array_sort(F.collect_list(F.struct("end", "top"))).alias("cells")).withColumns({"total": F.lit(total).cast("bigint"), "low": F.lit(low).cast("bigint")})
        least, most = flat.select(_least_capacity(shards, True), _least_capacity(shards, False)).first()
        walks = [_walk(F.lit(c).cast("bigint"), shards, far, even) for even in (False, True) for c, far in ((least, False), (most, True))]
        full_from, full_to, even_from, even_to = flat.select(*walks).first()
        spans = {(a, b) for a, b in [*zip(full_from, full_to, strict=True), *zip(even_from, even_to, strict=True)] if a < b}
        between = F.lit(False)
        for a, b in spans:
            between |= (F.col("end") > a) & (F.col("end") - F.col("bytes") < b)
        wanted = placed.where(between & (F.col("top") > 0))
        found = wanted.agg(F.count(F.lit(1)).alias("n"), F.max("shift").alias("shift")).first()
        if not found.n:
            break
        shift, bits = found.shift, max(1, (cells // found.n).bit_length() - 1)
        finer = wanted.where(F.col("shift") == shift).select("hash")
        own = F.shiftleft(F.shiftright("hash", shift), shift).alias("cell")
        part = small.select("hash", "bytes", own).join(F.broadcast(finer.withColumnRenamed("hash", "cell")), "cell")  # no more rows than cells
        rest = placed.drop("end").join(F.broadcast(finer.withColumn("shift", F.lit(shift))), ["hash", "shift"], "left_anti")
        known = settle(rest.unionByName(_gathered(part, max(0, shift - bits))))
    even = max(b - a for a, b in zip([0, *even_to], [*even_to, total], strict=True)) <= most
    cuts = [c for c in (even_to if even else full_to) if c < total]
    first = placed.where((F.col("end") - F.col("bytes")).isin(cuts)).select("big", "hash", (F.col("end") - F.col("bytes")).alias("start")).collect()  # a row for each cut
    return total, most, [(r.big, r.hash) for c in cuts for r in first if r.start == c]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, size, text_crc32, atom, shard, slot) of every row of ``docs``; ``atom`` is the hash of its group.

    The law is ``bytes``: the largest shard is as small as the order of groups
    allows and the others are near equal. A null text has no bytes and the CRC of
    the empty text. Slots run from 0 without a gap in each shard. Null and
    repeated ids are numbered like any other; an empty table gives an empty
    result; fewer groups than shards leave the last shards empty. Groups are told
    apart by a 64-bit hash: two texts that share one stay together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("atom")))
    groups = settle(rows.groupBy(F.col("atom").alias("hash")).agg(F.sum("size").alias("bytes")))
    total, _, cuts = plan(groups, shards, cells)
    large = groups.where(_is_large(total, shards)).select(F.col("hash").alias("atom"), (-F.col("bytes")).alias("big"))
    big = F.coalesce("big", F.lit(0))
    home = F.lit(0)
    for b, h in cuts:  # fewer than shards
        home += ((big > b) | (big == b) & (F.col("atom") >= h)).cast("int")
    stack = F.pmod(F.xxhash64("id", "text_crc32"), F.lit(STACKS)).cast("int")
    housed = rows.join(F.broadcast(large), "atom", "left").withColumn("shard", home).withColumn("stack", stack)
    counts = housed.groupBy("shard", "stack").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("stack").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * STACKS rows of three numbers
    offsets = counts.select("shard", "stack", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "stack").orderBy("id", "text_crc32", "size")
    numbered = housed.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "stack"])
    return numbered.select("id", "size", "text_crc32", "atom", "shard", (F.col("offset") + F.col("rank")).cast("bigint").alias("slot"))
