"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are cut into tiles. A tile holds fingerprints whose four
16-bit words have the same population counts, and at most about ``TILE_ROWS`` of
them. Flipping one bit changes one of these counts by one, so two fingerprints
within ``radius`` bits lie in tiles whose counts differ by ``radius`` in all; any
other pair of tiles is skipped. The pairs that remain are compared whole: numpy
exclusive-or of all against all, then bit counts.

From a pair of tiles only a spanning path of each linked group goes on, at most
as many edges as the tiles have rows, so a big group of near copies does not
give all its pairs. Components come from repeated hooking and pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import settle

RADIUS = 3
#: Fingerprints of a tile, on average, where a cell needs more than one.
TILE_ROWS = 2048
#: Shingles hashed at once, so that a long text takes bounded memory.
_BLOCK = 65_536
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text: word shingles, repeats included, XXH64.

    Fewer words than ``width`` are one shingle; no words give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    counts, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        joined, lengths = b" ".join(part), np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), _fingerprints(F.col(text_col)).alias("fp"))


def _spanning(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Edges that join what the two tiles link, a path through each group."""
    a, b = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
    if same:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return []
    nodes, ends = np.unique(np.concatenate((left[a], right[b])), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    joined = label[order[1:]] == label[order[:-1]]
    keys = nodes.view(np.int64)[order]
    return list(zip(keys[:-1][joined].tolist(), keys[1:][joined].tolist(), strict=True))


def _compare(radius: int):
    link = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def compare(left: pa.Array, right: pa.Array, same: pa.Array) -> pa.Array:
        def cut(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))

        (x, i), (y, j) = cut(left), cut(right)
        out = [[{"a": p, "b": q} for p, q in _spanning(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], s, radius)] for k, s in enumerate(same.to_pylist())]
        return pa.array(out, pa.list_(link))

    return compare


def _word_count(k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(65535)))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (fp) within ``radius``."""
    cells = distinct.select("fp", *(_word_count(k).cast("int").alias(f"c{k}") for k in range(4)))
    cells = cells.select("fp", (F.col("c0") + 17 * F.col("c1") + 289 * F.col("c2") + 4913 * F.col("c3")).alias("cell"))
    # at most 17**4 = 83,521 rows of two numbers
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))
    tiles = cells.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = settle(tiles)
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d[::-1] >= (0, 0, 0, 0)]
    near = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in steps)))
    left = tiles.select("cell", "part", "fps", near.alias("d"))
    digits = [F.floor(F.col("cell") / 17**k) % 17 + F.col(f"d.d{k}") for k in range(4)]
    inside = [(x >= 0) & (x <= 16) for x in digits]
    left = left.where(inside[0] & inside[1] & inside[2] & inside[3]).select(F.col("cell").alias("home"), F.col("part").alias("home_part"), F.col("fps").alias("left"), sum(x * 17**k for k, x in enumerate(digits)).cast("int").alias("cell"))
    own = F.col("home") == F.col("cell")
    pairs = left.join(tiles, "cell").where(~own | (F.col("home_part") <= F.col("part")))
    found = pairs.select(F.explode(_compare(radius)("left", "fps", own & (F.col("home_part") == F.col("part")))).alias("e"))
    return found.select("e.a", "e.b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component."""
    both = settle(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    state = settle(state)
    while True:
        seen = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("low"))
        hooked = state.join(seen, state.node == seen.a, "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid"))
        above = state.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        after = settle(hooked.join(above, "mid").select("node", "old", F.least("mid", "top").alias("root")))
        if after.where(F.col("root") != F.col("old")).isEmpty():
            return after.select("node", "root")
        state = after.select("node", "root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, fp, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id that chains of links reach from the row,
    its own included. A null text counts as one without words: fingerprint zero,
    which links like any other. Null ids never name a component unless it has no
    other. Repeated rows stay and agree. An empty table gives an empty result.
    Ids are integers, or text that is one; other columns are not looked at.
    """
    rows = settle(fingerprints(docs, id_col, text_col))
    classes = settle(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(links(classes.select("fp"), radius))
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(member.join(lowest, "root").select(F.col("fp").alias("named_fp"), "component_id"))
    return rows.join(named, rows.fp == named.named_fp).select("id", "text_hash", "fp", "component_id")
