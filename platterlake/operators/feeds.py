"""Change feeds: what one table has more or less often than another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADDED, GONE, ALTERED = "added", "gone", "altered"


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, values, times, change): how much more often (or less, below 0) ``after`` has each row, where that is not 0.

    Rows are counted with a sign, so repeats survive and no side is looked up in the
    other. A key that has rows of both signs is altered; otherwise what it has is
    added or gone. Nulls equal nulls. Both sides are shuffled once, by key: the
    counts by row and the sums by key find their rows together, as few as a key has.
    """
    signed = before.select(*keys, *values, F.lit(-1).alias("sign")).unionAll(after.select(*keys, *values, F.lit(1).alias("sign")))
    counted = signed.repartition(*keys).groupBy(*keys, *values).agg(F.sum("sign").alias("times")).where("times <> 0")
    own = Window.partitionBy(*keys)
    more, less = F.max("times").over(own) > 0, F.min("times").over(own) < 0
    return counted.withColumn("change", F.when(more & less, ALTERED).when(more, ADDED).otherwise(GONE))


def applied(before: DataFrame, feed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``before`` after a feed: the table that the feed was made from, in any order."""
    rows = before.select(*keys, *values, F.lit(1).cast("bigint").alias("times")).unionByName(feed.select(*keys, *values, "times"))
    left = rows.groupBy(*keys, *values).agg(F.sum("times").alias("times")).where("times > 0")
    return left.select(*keys, *values, F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("_copy")).drop("_copy")
