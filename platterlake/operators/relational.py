"""Relational shapes of the archive: offsets, coverage, containment, regions, checks.

All are DataFrame operators over tables keyed by a record. A record has at most
65,535 entries (its count is a u16 on the wire), so a window by record is bounded;
nothing is ordered across records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweep


def running_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: str, offset: str = "byte_offset", end: str = "byte_end") -> DataFrame:
    """Add where each entry starts and ends, from the lengths before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col(size)).over(before)
    return df.withColumn(end, total).withColumn(offset, F.col(end) - F.col(size))


def coverage(covered: DataFrame, key: str, slot: str, last: DataFrame, last_col: str) -> DataFrame:
    """(key, slot, times) for every slot from 0 to before ``last_col`` that is not covered exactly once.

    ``covered`` has a row for each time a slot is covered. Slots are made by
    exploding each record's own range, which the format bounds.
    """
    wanted = last.where(F.col(last_col) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(last_col).cast("int") - 1)).alias(slot))
    times = covered.groupBy(key, F.col(slot).cast("int").alias(slot)).agg(F.count(F.lit(1)).alias("times"))
    both = wanted.join(times, [key, slot], "full_outer").withColumn("times", F.coalesce("times", F.lit(0)))
    return both.where("times <> 1").select(key, slot, "times")


def contained(parts: DataFrame, wholes: DataFrame, key: str, start: str = "start", end: str = "end", how: str = "left_anti") -> DataFrame:
    """Parts that lie in no whole (``left_anti``) or in one (``left_semi``) of the same record, by a sweep."""
    return sweep.contained(parts, wholes, [key], start, end, how)


def labelled(entries: DataFrame, intervals: DataFrame, key: str, slot: str, first: str, count: str, label: str) -> DataFrame:
    """Entries with the label of the interval that covers them, null where none does."""
    slots = F.sequence(F.col(first).cast("int"), (F.col(first) + F.col(count) - 1).cast("int"))
    each = intervals.select(key, F.explode(slots).alias(slot), label)
    return entries.join(each, [key, slot], "left")


def merged_regions(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, amount: str, apart: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Neighbouring rows of equal label as one region: (keys, ordinal, label, start, end, amount, n_rows), and ``more`` aggregates of its rows.

    ``start`` and ``end`` are on the running clock of ``amount``; rows for which
    ``apart`` holds are regions of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    cut = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(label).over(w).isNull() & (F.row_number().over(w) == 1)
    if apart is not None:
        cut = cut | apart
    marked = df.withColumn("_cut", cut.cast("int"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("_island", F.sum("_cut").over(whole)).withColumn("_end", F.sum(amount).over(whole))
    grouped = placed.groupBy(*keys, F.col("_island").alias("ordinal")).agg(F.first(label).alias(label), F.min(F.col("_end") - F.col(amount)).alias("start"), F.max("_end").alias("end"), F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n_rows"), *(a.alias(n) for n, a in (more or {}).items()))
    return grouped.select(*keys, "ordinal", label, "start", "end", "amount", "n_rows", *(more or {}))


def merged_silences(df: DataFrame, keys: Sequence[str], order: Sequence[str], tracked: Column, amount: str) -> DataFrame:
    """(keys, after_entry, amount, n_rows): untracked rows merged by how many tracked rows come before."""
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_tracked", tracked).withColumn("after_entry", F.sum(F.col("_tracked").cast("int")).over(whole))
    return placed.where(~F.col("_tracked")).groupBy(*keys, "after_entry").agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n_rows"))


def interleaved(tracks: DataFrame, keys: Sequence[str], order: Sequence[str], count: str, gap: Column) -> DataFrame:
    """(keys, position, kind, first, count): each track followed by its gap, the last one by none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = tracks.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    parts = F.array(F.struct(F.lit("track").alias("kind"), F.col(count).cast("bigint").alias("count")), F.struct(F.lit("gap").alias("kind"), F.when(F.col("_last"), 0).otherwise(gap).cast("bigint").alias("count")))
    rows = numbered.select(*keys, "_n", F.posexplode(parts).alias("_side", "p")).select(*keys, "_n", "_side", "p.kind", "p.count").where("count > 0")
    ranged = running_offsets(rows, keys, ["_n", "_side"], "count", "first", "_end")
    return ranged.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_n", "_side"))).select(*keys, "position", "kind", "first", "count")


def checks(df: DataFrame, keys: Sequence[str], predicates: dict[str, Column]) -> DataFrame:
    """(keys, label, ok): a long row for each predicate; an unknown predicate fails."""
    each = F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(p, F.lit(False)).alias("ok")) for k, p in predicates.items()))
    return df.select(*keys, F.explode(each).alias("c")).select(*keys, "c.label", "c.ok")


def segment_plan(df: DataFrame, keys: Sequence[str], total: str, stride: int) -> DataFrame:
    """(keys, idx, start, length): the fixed-stride segments of each row's total."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(total).cast("bigint") - 1, F.lit(stride).cast("bigint"))
    rows = df.where(F.col(total) > 0).select(*keys, total, F.posexplode(starts).alias("idx", "start"))
    return rows.select(*keys, "idx", "start", F.least(F.lit(stride).cast("bigint"), F.col(total) - F.col("start")).alias("length"))


def one_value(df: DataFrame, keys: Sequence[str], same: str, unique: str) -> DataFrame:
    """(keys, one_value, no_repeat): whether ``same`` has one value and ``unique`` never repeats."""
    return df.groupBy(*keys).agg((F.count_distinct(same) == 1).alias("one_value"), (F.count(unique) == F.count_distinct(unique)).alias("no_repeat"))
