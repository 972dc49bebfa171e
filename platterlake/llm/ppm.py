"""Language-model scores by prediction by partial matching (PPM), pretrained on the corpus.

The model is a byte-context trie: how often each byte follows each context of up to
``ORDER`` bytes in the texts that teach, over all of them. A text is scored byte by
byte, with an end symbol: a byte that its longest context has seen gets its share of
the context's count; otherwise the context is escaped (method C: as often as it has
seen different bytes) and the next shorter one is asked, without the bytes that the
longer one has seen (symbol exclusion). Beyond the empty context all bytes left are
alike.

Neither trie nor vocabulary has a bound, so neither is collected or broadcast:

1. Texts are gathered into blocks of some MB as they are read, and written with their
   block's distinct grams (context and byte in one number) and distinct words, and
   their counts in texts that teach, cut by a hash into shards.
2. Shards merge all blocks' counts. The trie is then a table by order, and a gram's
   log-probability comes from the short orders to the long ones by joins: since what a
   long context has seen, its suffix has seen too, the counts left after exclusion are
   differences of sums. No key of these joins has more than 257 rows.
3. Shards answer the blocks with their grams' log-probabilities and their words'
   counts, and each block's texts are scored with its own answers.

So what is shuffled is one row for each block and shard, and the texts once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import settle, shelve

#: Bytes of the longest context; at most 6, so that a gram fits a long.
ORDER = 4
#: Bytes of text of a block and, on average, of all texts for each shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 16 << 20
#: Symbols: 256 bytes and the end.
SYMBOLS = 257
#: Neither byte occurs in UTF-8.
_START, _END = b"\xfe", b"\xff"
#: Places of a block that are looked at together, and bytes of a text that are split together.
_CHUNK, _SLICE = 1 << 21, 1 << 22
_PREPARED = "block bigint, id bigint, learn boolean, text string, shard int, grams binary, gram_n binary, words array<binary>, word_n binary"
_ANSWER = "block bigint, grams binary, logs binary, words array<binary>, word_n binary, tokens bigint, kinds bigint"
_SCORED = "id bigint, learn boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, split at ASCII white space, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and text[end : end + 1] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


class _Grams:
    """Places of texts put one after another, each after ``order`` start bytes and before its end."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        self.order, pad = order, _START * order
        self.data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, _END)), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + order + 1
        self.starts = np.cumsum(sizes) - sizes

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, grams, whether each is of a text and not of the start before it)."""
        for a in range(0, len(self.data), _CHUNK):
            b = min(a + _CHUNK, len(self.data))
            part = self.data[max(a - self.order, 0) : b].astype(np.int64)
            part = np.concatenate((np.zeros(self.order - min(a, self.order), dtype=np.int64), part))
            packed = np.zeros(b - a, dtype=np.int64)
            for k in range(self.order + 1):
                packed |= part[self.order - k : self.order - k + b - a] << (8 * k)
            real = np.ones(b - a, dtype=bool)
            near = self.starts[np.searchsorted(self.starts, a - self.order, "right") : np.searchsorted(self.starts, b)]
            pads = (near[:, None] + np.arange(self.order)).ravel() - a
            real[pads[(pads >= 0) & (pads < b - a)]] = False
            yield a, packed, real

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams and how often each occurs."""
        found = [np.unique(packed[real], return_counts=True) for _, packed, real in self.chunks()]
        return _summed(np.concatenate([np.empty(0, np.int64), *(g for g, _ in found)]), np.concatenate([np.empty(0, np.int64), *(n for _, n in found)]))

    def totals(self, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each text, the sum of its grams' values."""
        out, index = np.zeros(len(self.starts)), pd.Index(grams)
        for a, packed, real in self.chunks():
            value = np.zeros(len(packed))
            value[real] = values[index.get_indexer(packed[real])]
            first, last = np.searchsorted(self.starts, a, "right") - 1, np.searchsorted(self.starts, a + len(packed))
            out[first:last] += np.add.reduceat(value, np.maximum(self.starts[first:last] - a, 0))
        return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, at, n)
    return distinct, total


def _lower(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(column, "")).cast(pa.large_binary()).to_pylist()


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def _asked(block: int, rows: pa.Table, shards: int, order: int) -> pa.RecordBatch:
    """A row for each shard: the block's distinct grams and words of it, and their counts where they teach."""
    texts, learn = _lower(rows["text"]), rows["learn"].to_pylist()
    known, other = (([t for t, x in zip(texts, learn, strict=True) if x == want]) for want in (True, False))
    seen, more = _Grams(known, order).counts(), _Grams(other, order).counts()
    grams, counts = _summed(np.concatenate((seen[0], more[0])), np.concatenate((seen[1], np.zeros(len(more[0]), dtype=np.int64))))
    words: Counter[bytes] = Counter({b"": len(known)})
    for t in known:
        for part in words_of(t):
            words.update(part)
    for t in other:
        for part in words_of(t):
            for w in set(part):
                if w not in words:
                    words[w] = 0
    home = _shard(grams, shards)
    place, cuts = np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=shards))
    by_shard: list[list[bytes]] = [[] for _ in range(shards)]
    for w in words:
        by_shard[zlib.crc32(w) % shards].append(w)
    out = []
    for k, (a, b) in enumerate(zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True)):
        if b > a or by_shard[k]:
            own = place[a:b]
            out.append((k, grams[own].tobytes(), counts[own].tobytes(), by_shard[k], np.array([words[w] for w in by_shard[k]], dtype=np.int64).tobytes()))
    columns = [list(c) for c in zip(*out, strict=True)]
    none = pa.nulls(len(out))
    return pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.binary())), pa.array(columns[4], pa.binary())], names=_names(_PREPARED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _prepare(shards: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def written() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            for part in rows.to_batches():
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), part["id"], part["learn"], part["text"], *(pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()))], names=_names(_PREPARED))
            yield _asked(block, rows, shards, order)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - base
                at = to
                if at < batch.num_rows or size >= BLOCK_BYTES:
                    yield from written()
                    held, size, block = [], 0, block + 1
        if held:
            yield from written()

    return run


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """Distinct grams of a shard with their counts."""
    grams, n = _summed(*(np.frombuffer(b"".join(rows[c].to_pylist()), dtype=np.int64) for c in ("grams", "gram_n")))
    return pa.table({"g": grams, "n": n})


def _count_words(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block its words of a shard with their counts in all blocks; in a row without a block the shard's tokens and distinct words."""
    words = rows["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, codes, np.frombuffer(b"".join(rows["word_n"].to_pylist()), dtype=np.int64))
    ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    each = [total[codes[b - n : b]].tobytes() for b, n in zip(ends, np.diff(ends, prepend=0), strict=True)]
    n = rows.num_rows + 1
    return pa.table({"block": pa.array([*rows["block"].to_pylist(), None], pa.int64()), "grams": pa.nulls(n, pa.binary()), "logs": pa.nulls(n, pa.binary()), "words": pa.array([*words.to_pylist(), None], pa.list_(pa.binary())), "word_n": pa.array([*each, None], pa.binary()), "tokens": pa.array([None] * (n - 1) + [int(total.sum())], pa.int64()), "kinds": pa.array([None] * (n - 1) + [int((total > 0).sum())], pa.int64())})


def _tell_logs(key: tuple, rows: pa.Table, logs: pa.Table) -> pa.Table:
    """For each block its grams of a shard with their log-probabilities."""
    g, value = logs["g"].to_numpy(), logs["log"].to_numpy()
    order = np.argsort(g)
    g, value = g[order], value[order]
    grams = rows["grams"].to_pylist()
    each = [value[np.searchsorted(g, np.frombuffer(x, dtype=np.int64))].tobytes() for x in grams]
    n = rows.num_rows
    return pa.table({"block": rows["block"], "grams": pa.array(grams, pa.binary()), "logs": pa.array(each, pa.binary()), "words": pa.nulls(n, pa.list_(pa.binary())), "word_n": pa.nulls(n, pa.binary()), "tokens": pa.nulls(n, pa.int64()), "kinds": pa.nulls(n, pa.int64())})


def _score(order: int, tokens: int, kinds: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _lower(rows["text"])
        grams, logs = (np.frombuffer(b"".join(x for x in answers[c].to_pylist() if x is not None), dtype=t) for c, t in (("grams", np.int64), ("logs", np.float64)))
        score = _Grams(texts, order).totals(grams, logs) / math.log(10)
        place, counts = {}, []
        for words, n in zip(answers["words"].to_pylist(), answers["word_n"].to_pylist(), strict=True):
            if n is not None:
                place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
                counts.append(np.frombuffer(n, dtype=np.int64))
        count = np.concatenate(counts)
        value = np.log10((count + 0.5) / (tokens + 0.5 * (kinds + 1)))
        n_tokens, n_known, base = [], [], []
        for t in texts:
            codes = [np.fromiter(map(place.__getitem__, part), dtype=np.int64) for part in words_of(t)]
            codes = np.concatenate([*codes, [place[b""]]])
            n_tokens.append(len(codes))
            n_known.append(int((count[codes] > 0).sum()))
            base.append(float(value[codes].sum()))
        return pa.table({"id": rows["id"], "learn": rows["learn"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def _suffix(g: str, order: int) -> Column:
    """The last ``order`` bytes of a gram's context, and its byte."""
    return F.col(g).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, log) of every gram of ``counts`` (g, n): the natural log of the chance that its byte follows its context.

    A gram with n = 0 is one that is asked for but was not seen in training.
    """
    by_order = [counts]
    for k in reversed(range(order)):
        by_order.append(settle(by_order[-1].groupBy(_suffix("g", k).alias("g")).agg(F.sum("n").alias("n"))))
    below = by_order.pop()
    seen = F.when(F.col("n") > 0, 1).otherwise(0)
    alone = Window.partitionBy(F.lit(0))  # at most 257 rows
    known = below.select("g", "n", F.sum("n").over(alone).alias("total"), F.sum(seen).over(alone).alias("kinds"))
    known = settle(known.withColumn("rest", -F.log(F.lit(SYMBOLS) - F.col("kinds"))))
    for k in range(1, order + 1):
        lower = known.select(F.col("g").alias("low"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"), F.col("rest").alias("low_rest"))
        context = Window.partitionBy(F.shiftright("g", 8))
        met = by_order.pop().join(lower, _suffix("g", k - 1) == F.col("low"))
        met = met.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(seen).over(context), "out": F.sum(F.when(F.col("n") > 0, F.col("low_n")).otherwise(0)).over(context)})
        # what the shorter context has left when the bytes that this one has seen are taken out
        left, new = F.col("low_total") - F.col("out"), F.col("low_kinds") - F.col("kinds")
        rest = F.when(F.col("low_n") > 0, F.log(F.col("low_n") / (left + new))).when(new > 0, F.log(new / (left + new)) + F.col("low_rest")).otherwise(F.col("low_rest"))
        known = settle(met.select("g", "n", "total", "kinds", F.when(F.col("n") == 0, rest).alias("rest")))
    share = F.col("total") + F.col("kinds")
    return known.select("g", F.when(F.col("n") > 0, F.log(F.col("n") / share)).when(F.col("kinds") > 0, F.log(F.col("kinds") / share) + F.col("rest")).otherwise(F.col("rest")).alias("log"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 by five."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def score(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, learn, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``learn`` says which rows teach (default: those that are not ``held_out``). Texts
    are taken with A-Z in lower case. ``score`` is the log10 probability of the whole
    text and its end by the trie; ``base_score`` that of its words (split at ASCII
    white space) and an end token by their smoothed share of ``train_tokens``;
    ``n_known`` of the ``n_tokens`` occur in training. A null text is empty: one
    token, the end. Where no row teaches, all bytes are alike and no token is known.
    Repeated rows stay, teach as often as they occur and agree; null ids are hashed
    as the empty text. An empty table gives an empty result. Ids are integers, or
    text that is one; other columns are not looked at.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is from 1 to 6")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), (~held_out(id_col) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = 8 + total // SHARD_BYTES
    ready = shelve(rows.mapInArrow(_prepare(shards, order), _PREPARED))
    asked = ready.where(F.col("shard").isNotNull())
    counts = settle(asked.select("shard", "grams", "gram_n").groupBy("shard").applyInArrow(_merged, "g bigint, n bigint"))
    logs = log_probabilities(counts, order).select("g", "log", _shard_column("g", shards).alias("shard"))
    told = asked.select("block", "shard", "grams").groupBy("shard").cogroup(logs.groupBy("shard")).applyInArrow(_tell_logs, _ANSWER)
    counted = shelve(asked.select("block", "shard", "words", "word_n").groupBy("shard").applyInArrow(_count_words, _ANSWER))
    vocabulary = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    answers = told.unionByName(counted.where(F.col("block").isNotNull()))
    texts = ready.where(F.col("shard").isNull()).select("block", "id", "learn", "text")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, vocabulary.tokens, vocabulary.kinds), _SCORED)
    return scored.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("bigint"))


def _shard_column(g: str, shards: int) -> Column:
    """As ``_shard``, for a column."""

    @F.arrow_udf("int")
    def run(grams: pa.Array) -> pa.Array:
        return pa.array(_shard(grams.to_numpy(zero_copy_only=False), shards), pa.int32())

    return run(F.col(g))
