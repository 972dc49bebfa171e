"""Mergeable states: distinct counts and quantiles kept by period, and merged for any range of periods.

A period's state is a row of three sketches: HyperLogLog and theta of a value that is
counted, KLL of a number. They are made once, with partial aggregation, and stored; a
range reads as many rows as it has periods, not the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the size of the HyperLogLog and theta sketches, and k of KLL: about 1.6, 1.6 and 1.3 % of standard or rank error.
LOG_SIZE, K = 12, 200


def states(rows: DataFrame, period: Column, keys: Sequence[str], counted: str, number: str) -> DataFrame:
    """(period, keys, hll, theta, kll) of a table; ``period`` is a whole number such as a day. Nulls are in no sketch, and a row without a period in no state."""
    kept = rows.withColumn("period", period.cast("bigint")).where("period is not null")
    return kept.groupBy("period", *keys).agg(F.hll_sketch_agg(counted, LOG_SIZE).alias("hll"), F.theta_sketch_agg(counted, LOG_SIZE).alias("theta"), F.kll_sketch_agg_double(F.col(number).cast("double"), K).alias("kll"))


def add(stored: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of both tables: what ``states`` gives for the rows of both, up to the sketches' error."""
    return _merged(stored.unionByName(more), ["period", *keys])


def _merged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", LOG_SIZE).alias("theta"), F.kll_merge_agg_double("kll", K).alias("kll"))


def ranged(stored: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """(period, keys, hll, theta, kll) of the ``length`` periods up to each period that has a state or follows one within the range."""
    ends = F.explode(F.sequence(F.col("period"), F.col("period") + (length - 1))).alias("until")
    last = stored.groupBy(*keys).agg(F.max("period").alias("last")).select(*(F.col(k).alias(f"_{k}") for k in keys), "last")
    each = stored.select(ends, *keys, "hll", "theta", "kll")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    kept = each.join(last, same & (F.col("until") <= F.col("last"))) if keys else each
    return _merged(kept.select(F.col("until").alias("period"), *keys, "hll", "theta", "kll"), ["period", *keys])


def read(merged: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """``merged`` with hll_count, theta_count, n and quantiles, an array for ``shares``, in place of the sketches."""
    quantiles = F.kll_sketch_get_quantile_double("kll", F.array(*(F.lit(x) for x in shares)))
    return merged.select("*", F.hll_sketch_estimate("hll").alias("hll_count"), F.round(F.theta_sketch_estimate("theta")).cast("bigint").alias("theta_count"), F.kll_sketch_get_n_double("kll").alias("n"), quantiles.alias("quantiles")).drop("hll", "theta", "kll")
