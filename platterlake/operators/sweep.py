"""Joins by order: values carried along a sorted line, as of a place or over intervals.

What is known at a place is the greatest value at or before it. Both sides become
points of one line, a row for each key and place, whatever its number of rows, and
the line is cut into ranges of about as many points. A range's greatest value is
carried to the later ranges of the key first, then along the points within a range.
So a key with a third of all rows is many ranges, a place with a third of all rows
is one point, and the work is that of sorting.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary one, a cluster is refused."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master.startswith("local[") or context.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="platterlake-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there, so that what reads it twice makes it once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def carried(asked: DataFrame, given: DataFrame, keys: Sequence[str], at: str, value: Column, name: str, given_at: str | None = None, given_keys: Sequence[str] | None = None, inclusive: bool = True) -> DataFrame:
    """``asked`` with ``name``: the greatest ``value`` of the rows of ``given`` with its keys at or before its place.

    ``value`` is an expression over ``given`` of any type with an order, structs
    included; null values are passed over. Without ``inclusive`` only earlier places
    count. A row whose key or place is null, or that nothing precedes, gets null. All
    rows and columns of ``asked`` stay, repeats included; ``name`` must not be one of
    them. Empty tables are like any other.
    """
    given_keys, given_at = given_keys or keys, given_at or at
    n = len(keys)
    spot = [*(f"k{i}" for i in range(n)), "at"]

    def placed(df: DataFrame, by: Sequence[str], where: str, *more: Column) -> DataFrame:
        return df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.col(where).alias("at"), *more)

    known = placed(given, given_keys, given_at, value.alias("value"))
    rows = placed(asked, keys, at, F.struct("*").alias("row"))
    both = known.unionByName(rows.select(*spot, F.lit(None).cast(known.schema["value"].dataType).alias("value")))
    real = F.lit(True)
    for c in spot:
        real = real & F.col(c).isNotNull()
    points = both.where(real).groupBy(*spot).agg(F.max("value").alias("value"))
    # the cuts come from a sample, so the ranges are written down before they are used twice
    line = settle(points.repartitionByRange(*spot).select("*", F.spark_partition_id().alias("range")))
    cell = [*spot[:-1], "range"]
    before = Window.partitionBy(*spot[:-1]).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tails = line.groupBy(*cell).agg(F.max("value").alias("tail")).select(*cell, F.max("tail").over(before).alias("carry"))
    within = Window.partitionBy(*cell).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    best = line.select(*spot, "range", F.max("value").over(within).alias("own")).join(tails, cell).select(*(F.col(c).alias(f"p_{c}") for c in spot), F.greatest("own", "carry").alias("best"))
    same = F.lit(True)
    for c in spot:
        same = same & (F.col(c) == F.col(f"p_{c}"))
    return rows.join(best, same, "left").select("row.*", F.col("best").alias(name))


def contained(parts: DataFrame, wholes: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", how: str = "left_anti") -> DataFrame:
    """Parts that lie in no whole (``left_anti``) or in one (``left_semi``) with the same keys.

    A part lies in a whole that begins at or before it and ends at or after its end,
    so the furthest end so far decides. A part with a null in its key or ends lies in
    none; a whole with one holds none.
    """
    furthest = carried(parts, wholes, keys, start, F.col(end), "_furthest")
    inside = F.coalesce(F.col("_furthest") >= F.col(end), F.lit(False))
    return furthest.where(inside if how == "left_semi" else ~inside).drop("_furthest")


def _number(df: DataFrame, at: str) -> Column:
    """A place as a number: microseconds of a time, days of a date, or itself."""
    kind = df.schema[at].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(at).cast("timestamp"))
    return F.unix_date(at) if isinstance(kind, T.DateType) else F.col(at)


def as_of(asked: DataFrame, given: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], ties: Sequence[str] = (), name: str = "found", given_at: str | None = None, inclusive: bool = True, forward: bool = False, within: int | None = None, then: Sequence[str] = ()) -> DataFrame:
    """``asked`` with ``name``, a struct of ``carry`` of the latest row of ``given`` with its keys at or before its place.

    Of rows at one place that with the greatest ``ties``, then ``carry``, is taken.
    ``inclusive`` says whether the same place counts; ``forward`` takes the earliest
    row at or after the place instead; ``within`` is how far away it may be, in the
    place's units (microseconds of a time, days of a date). ``then`` are numbers or
    times of both tables that order the rows of one place: what comes before a row by
    them is before it. A row without one gets null. Rows of ``asked`` all stay, as
    ``carried`` has it.
    """
    given_at = given_at or at
    sign = -1 if forward else 1

    def placed(df: DataFrame, where: str) -> Column:
        parts = [(_number(df, c) * sign).alias(n) for c, n in ((where, "at"), *((c, f"then{i}") for i, c in enumerate(then)))]
        known = F.lit(True)
        for c in (where, *then):
            known = known & F.col(c).isNotNull()
        return F.when(known, F.struct(*parts)) if then else parts[0]

    there = given.withColumn("_place", placed(given, given_at))
    here = asked.withColumn("_place", placed(asked, at))
    place = F.struct(F.col("_place").alias("at"), *ties, F.struct(*carry).alias("row"))
    met = carried(here, there, keys, "_place", F.when(F.col("_place").isNotNull(), place), "_best", inclusive=inclusive)
    found = F.col("_best.row")
    if within is not None:
        number = (lambda c: F.col(c)["at"]) if then else F.col
        found = F.when(number("_place") - number("_best.at") <= within, found)
    return met.withColumn(name, found).drop("_best", "_place")
