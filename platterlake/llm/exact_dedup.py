"""Exact dedup with a minimal perfect hash over historical digests.

The distinct SHA-256 digests of the texts that came earlier are spread over
buckets by a hash of the digest. Each bucket gets a minimal perfect hash: a few
levels of bit arrays, where a key that meets no other on its level owns the bit
it falls on and the others go to the next level; the rank of the owned bit is
the key's slot. Slots hold the full digest, the winner's locator and a count.

New digests are looked up in their bucket. A lookup counts only if all 32 bytes
in the slot agree, since a perfect hash gives any stranger some slot too. Members
are merged with their slot; nonmembers are grouped by themselves.

Digests are distinct before they are bucketed, so a text with millions of copies
is one key. The last step, from digests back to rows, is a plain equi-join whose
two sides are both fresh shuffles, which adaptive execution splits on hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settle

#: Keys that a bucket of the index holds on average.
BUCKET_KEYS = 16_384
#: Bits of a level for each key that reaches it.
SPREAD = 2
_MIX_A, _MIX_B, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15


def _spots(words: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bit of a level that each key falls on; ``words`` is (n, 4) uint64."""
    x = words[:, level % 4] + np.uint64((level + 1) * _STEP % 2**64)
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(29))) * _MIX_B
    return ((x ^ (x >> np.uint64(32))) % np.uint64(width)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_hash(digests: list[bytes]) -> list[np.ndarray]:
    """Levels (boolean arrays) of a minimal perfect hash over distinct digests."""
    left, levels = _words(digests), []
    with np.errstate(over="ignore"):
        while len(left):
            if len(levels) > 200:
                raise ValueError("digests are not distinct")
            width = max(64, SPREAD * len(left))
            spots = _spots(left, len(levels), width)
            alone = np.bincount(spots, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[spots]]
    return levels


def find_slots(levels: list[np.ndarray], digests: list[bytes]) -> np.ndarray:
    """Slot of each digest; -1 where no level has a bit for it."""
    words = _words(digests)
    slots = np.full(len(words), -1, dtype=np.int64)
    left, before = np.arange(len(words)), 0
    with np.errstate(over="ignore"):
        for k, bits in enumerate(levels):
            rank = np.cumsum(bits) - 1 + before
            spots = _spots(words[left], k, len(bits))
            owned = bits[spots]
            slots[left[owned]] = rank[spots[owned]]
            left, before = left[~owned], before + int(bits.sum())
    return slots


_INDEX = "bucket int, widths array<int>, levels array<binary>, digests array<binary>, winners array<bigint>, counts array<bigint>"
_FOUND = "digest binary, winner bigint, n bigint, member boolean"


def _index_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    digests = rows["digest"].to_pylist()
    levels = build_hash(digests)
    order = np.empty(len(digests), dtype=np.int64)
    order[find_slots(levels, digests)] = np.arange(len(digests))
    held = rows.take(pa.array(order))
    lists = {
        "widths": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
        "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
        "digests": pa.array([held["digest"].to_pylist()], pa.list_(pa.binary())),
        "winners": pa.array([held["winner"].to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([held["n"].to_pylist()], pa.list_(pa.int64())),
    }
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **lists})


def _lookup_bucket(key: tuple, fresh: pa.Table, index: pa.Table) -> pa.Table:
    seen = fresh["digest"].to_pylist()
    winner, count = fresh["winner"].to_pylist(), fresh["n"].to_pylist()
    held, best, total = [], [], []
    if index.num_rows:
        held, best, total = (index[c][0].as_py() for c in ("digests", "winners", "counts"))
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=w).astype(bool) for b, w in zip(index["levels"][0].as_py(), index["widths"][0].as_py(), strict=True)]
    member = [True] * len(held)
    for i, slot in enumerate(find_slots(levels, seen) if held and seen else [-1] * len(seen)):
        if slot >= 0 and held[slot] == seen[i]:
            best[slot] = max((x for x in (best[slot], winner[i]) if x is not None), default=None)
            total[slot] += count[i]
        else:
            held.append(seen[i])
            best.append(winner[i])
            total.append(count[i])
            member.append(False)
    return pa.table({"digest": pa.array(held, pa.binary()), "winner": pa.array(best, pa.int64()), "n": pa.array(total, pa.int64()), "member": pa.array(member, pa.bool_())})


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, winner, n) of rows (id, digest); combined on the map side first."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket: the perfect hash and its slots."""
    return distinct.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_index_bucket, _INDEX)


def look_up(fresh: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Merge distinct new digests with the index: (digest, winner, n, member)."""
    keyed = fresh.withColumn("bucket", _bucket(buckets))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_lookup_bucket, _FOUND)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, digest) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``docs``.

    ``history`` is a table of the same shape whose texts count as seen already.
    Without it, ``docs`` is taken as an archive that grew by id: about half of the
    rows, those with the smallest ids, are the history, the rest is looked up against
    it. Buckets are as many as rows on either side ask for, so neither a small history
    nor odd or missing ids put more than a bucket's share into one task.

    Of equal texts the largest id stays, wherever it is. A null text is an empty
    text. A null id never wins over another; a group that has only null ids keeps
    them all. Rows that repeat an id and its text are one document: both carry
    the same flags. An empty table gives an empty result.
    Ids are integers, or text that is one; other columns are not looked at.
    """
    rows = settle(digest_rows(docs, id_col, text_col, normalise))
    if history is None:
        middle = rows.agg(F.percentile_approx("id", 0.5, 1000)).first()[0]
        old = F.coalesce(F.col("id") <= F.lit(middle).cast("bigint"), F.lit(False))
        earlier, fresh = rows.where(old), rows.where(~old)
    else:
        earlier, fresh = digest_rows(history, id_col, text_col, normalise), rows
    known = settle(distinct_digests(earlier))
    buckets = max(1, -(-max(known.count(), rows.count()) // BUCKET_KEYS))
    groups = look_up(distinct_digests(fresh), build_index(known, buckets), buckets)
    found = rows.join(groups, "digest")
    return found.select("id", "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("winner")).alias("kept"))
