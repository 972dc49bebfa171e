"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (a shorter item is one
window). Its shingles of three words are ordered by rarity, counted over all
documents. A window can only occur where each of its shingles occurs, so with
full containment the necessary prefix is one shingle, the rarest. Documents are
probed for prefix shingles alone. A probe that hits must leave room for the
window on both sides (length and position), and is then verified by comparing
words outwards; every run of at least a window is a hit.

The benchmark side is cut into blocks of at most ``BLOCK_WORDS`` words, and only a
block is ever broadcast; a benchmark beyond one block takes a pass for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle

WINDOW = 13
SHINGLE = 3
#: Words of the benchmark in one broadcast.
BLOCK_WORDS = 2_000_000
#: Bytes 0-9, a-z and beyond ASCII are words; A-Z go to lower case; the rest are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Block:
    """Distinct word sequences of some items, and what to look for."""

    def __init__(self, sequences: dict[tuple[bytes, ...], list[str]], window: int):
        self.sequences = list(sequences)
        self.names = list(sequences.values())
        self.window = window
        self.places: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for k, seq in enumerate(self.sequences):
            width = min(SHINGLE, len(seq))
            for at in range(len(seq) - width + 1):
                self.places.setdefault(seq[at : at + width], []).append((k, at))
        self._probe()

    def _probe(self) -> None:
        self.widths = sorted({len(s) for s in self.places})
        self.firsts = {s[0] for s in self.places}

    def keep_prefixes(self, counts: dict[tuple[bytes, ...], int]) -> None:
        """Keep only the rarest shingle of each window; ties go by the words."""
        rank = {s: (counts.get(s, 0), s) for s in self.places}
        kept: dict[tuple[bytes, ...], set[tuple[int, int]]] = {}
        for k, seq in enumerate(self.sequences):
            size, width = min(self.window, len(seq)), min(SHINGLE, len(seq))
            for start in range(len(seq) - size + 1):
                rarest = min((rank[seq[at : at + width]], at) for at in range(start, start + size - width + 1))
                kept.setdefault(rarest[0][1], set()).add((k, rarest[1]))
        self.places = {s: sorted(v) for s, v in kept.items()}
        self._probe()

    def probes(self, doc: list[bytes]) -> Iterator[tuple[tuple[bytes, ...], int]]:
        places, firsts = self.places, self.firsts
        spots = [i for i, w in enumerate(doc) if w in firsts]
        for width in self.widths:
            for i in spots:
                if (s := tuple(doc[i : i + width])) in places:
                    yield s, i

    def hits(self, doc: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """By sequence, the runs of document words that its windows cover."""
        found: dict[int, list[tuple[int, int]]] = {}
        done: dict[tuple[int, int], int] = {}
        for shingle, i in self.probes(doc):
            for k, at in self.places[shingle]:
                seq = self.sequences[k]
                size = min(self.window, len(seq))
                if done.get((k, i - at), -1) > i or len(doc) < size:
                    continue
                a, b = i, i + len(shingle)
                low, high = max(0, i - at), min(len(doc), i - at + len(seq))
                if high - low < size:  # no room for a window here
                    continue
                while a > low and doc[a - 1] == seq[a - 1 - i + at]:
                    a -= 1
                while b < high and doc[b] == seq[b - i + at]:
                    b += 1
                done[k, i - at] = b
                if b - a >= size:
                    found.setdefault(k, []).append((a, b))
        return found


def _count_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(s for s, _ in block.probes(words(text.as_py())))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["shingle", "n"])

    return run


_FOUND = "struct<n_words: bigint, spans: array<struct<a: bigint, b: bigint>>, items: array<string>>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _match_pass(shared):
    @F.arrow_udf(_FOUND)
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        block = shared.value
        for texts, befores in batches:
            out = []
            for text, before in zip(texts, befores, strict=True):
                doc = words(text.as_py())
                known = before.as_py() or {"spans": [], "items": []}
                spans, items = [(s["a"], s["b"]) for s in known["spans"]], set(known["items"])
                for k, runs in block.hits(doc).items():
                    spans += runs
                    items.update(block.names[k])
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append({"n_words": len(doc), "spans": [{"a": a, "b": b} for a, b in merged], "items": sorted(items)})
            yield pa.array(out, _FOUND_ARROW)

    return match


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """Blocks of the benchmark; together they hold every item that has words."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        held: dict[tuple[bytes, ...], list[str]] = {}
        part = named.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else named
        for row in part.toLocalIterator():
            if seq := tuple(words(row.text)):
                held.setdefault(seq, []).append(row.id)
        if held:
            yield Block(held, window)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` as (row, found).

    ``row`` is the row as it was, whatever its columns are called; ``found`` has
    n_words, the merged spans of hit words and the ids of the items that occur.
    A null or wordless text has no words and no hits; an item without words never
    occurs; items of equal words count each under its own id, an item without an
    id under the empty one. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    nothing = F.lit(None).cast(_FOUND)
    out, first = None, True
    for block in blocks(items, item_id_col, item_text_col, window, block_words):
        shared = spark.sparkContext.broadcast(block)
        seen = packed.select(text.cast("string").alias("text")).mapInArrow(_count_pass(shared), "shingle binary, n bigint")
        totals = seen.groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()  # no more than the block's shingles
        block.keep_prefixes({tuple(bytes(r.shingle).split()): r.n for r in totals})
        shared = spark.sparkContext.broadcast(block)
        before = packed.withColumn("found", nothing) if first else settle(out)
        out = before.select("row", _match_pass(shared)(text.cast("string"), F.col("found")).alias("found"))
        first = False
    if out is None:
        match = _match_pass(spark.sparkContext.broadcast(Block({}, window)))
        out = packed.select("row", match(text.cast("string"), nothing).alias("found"))
    return out


def verdict(found: DataFrame, least_share: int = 20) -> DataFrame:
    """(row, n_words, n_hit, n_items, items, contaminated) from ``decontaminate``.

    A row is contaminated if it has a hit and ``least_share`` times its hit words
    reach its words.
    """
    n_hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    flat = found.select("row", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"), F.col("found.items").alias("items"))
    return flat.withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))
