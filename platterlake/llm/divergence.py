"""Divergence of sources within a language, term by term, over distinct count columns.

A term's counts in the sources of its language, zeros left out, are its column.
Terms with the same column contribute the same to every pair of sources, so a column
is evaluated once and its result multiplied by the number of its terms; only the
ranking of terms goes back to the terms themselves. A column is evaluated only for
pairs of which it has at least one source: all columns with neither contribute alike,
and their number is what is left of the language's terms.

Shares add up to SCALE and a little, so sums fit a long below two thousand million
kept terms. They are whole numbers, 1 + floor(SCALE * (count + 1) / (N + V)) for a source of N
occurrences of V kept terms, and (p - q)² / q is rounded down, so sums are exact.

Terms are counted as texts are read, in batches, so what is shuffled is one row for
each term, source and batch; columns are grouped by language and term, never by
language or source alone. Ranks come from windows with a limit, which Spark applies
before the shuffle, and from one row for each pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import settle
from ._spans import let

SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, at least, and terms of a source's report.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Different (language, source, term) that are counted before they are passed on.
_HELD = 1 << 19
#: Sources with their totals that are broadcast; beyond that Spark joins them by shuffle.
BROADCAST_SOURCES = 100_000
#: Shares that are compared with one at once.
_CELLS = 1 << 20
#: Bytes of text that are split together.
_SLICE = 1 << 22
#: Letters as they are, A-Z in lower case, bytes beyond ASCII as they are, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang binary, source binary, term binary, n bigint, docs bigint"


def _terms(text: bytes) -> Counter[bytes]:
    """A text's terms with their counts."""
    text = text.translate(_LETTERS)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split(b" "))
        at = end
    found.pop(b"", None)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[bytes, bytes], tuple[Counter[bytes], Counter[bytes]]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            size = len(terms)
            columns = [pa.array([lang] * size, pa.binary()), pa.array([source] * size, pa.binary()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].cast(pa.large_binary()).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = _terms(text), len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before + 1
            if size > _HELD:
                yield from flushed()
                held, size = {}, 0
    yield from flushed()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), summed; each (lang, source) that occurs has a row for the empty term."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(whole(lang_col).alias("lang"), whole(source_col).alias("source"), whole(text_col).alias("text"))
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    return rows.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).select(*text, "n", "docs")


def columns(counts: DataFrame) -> DataFrame:
    """(lang, term, column, digest) of the kept terms; a column is its (source, n) by source, and known by its SHA-256."""
    held = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("column")
    return counts.where("term <> ''").groupBy("lang", "term").agg(held, F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "column", F.unhex(F.sha2(F.to_json("column"), 256)).alias("digest"))


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """A count's share; only a count whose product leaves a long needs decimals."""
    whole = ((count + 1).cast("decimal(38,0)") * F.lit(SCALE)).cast("decimal(38,0)")
    wide = F.call_function("div", whole, (total + kinds).cast("decimal(38,0)")).cast("bigint")
    quick = F.call_function("div", (count + 1).cast("bigint") * F.lit(SCALE).cast("bigint"), (total + kinds).cast("bigint"))
    return F.when(count < 9 * SCALE, quick).otherwise(wide) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` has a row for each other source of the language: its divergence
    from the source, summed over all kept terms (0 if there are none). Part ``term``
    has the source's TOP_TERMS terms that are more frequent in it than in the
    language, by their divergence from it. Ranks go by value, then item in the order
    of its bytes. A null text, language or source is an empty one, which is a value
    like any other. Repeated rows count as often as they occur. An empty table gives
    an empty result. Only these three columns are looked at.
    """
    counts = settle(term_counts(docs, text_col, lang_col, source_col))
    held = settle(columns(counts))
    distinct = settle(held.groupBy("lang", "digest").agg(F.first("column").alias("column"), F.count(F.lit(1)).alias("terms")))
    kinds = distinct.groupBy("lang").agg(F.sum("terms").alias("kinds"))
    total = distinct.select("lang", "terms", F.explode("column").alias("c")).groupBy("lang", "c.source").agg(F.sum(F.col("terms") * F.col("c.n")).alias("total"))
    own = counts.where("term = ''").select("lang", "source").join(total, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "kinds"])
    own = settle(own.select("lang", "source", "total", "kinds", F.sum("total").over(Window.partitionBy("lang")).alias("lang_total")))
    small = own.count() <= BROADCAST_SOURCES
    listed = own.where("kinds > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total", _share(F.lit(0), F.col("total"), F.col("kinds")).alias("least")))).alias("sources"), F.first("kinds").alias("kinds"), F.first("lang_total").alias("lang_total"))
    listed = F.broadcast(listed) if small else listed
    met = distinct.join(listed, "lang")
    return _pairs(met, own, small).unionByName(_terms_of(met, held))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value, covered): for each pair of a language's sources, by number, what the columns with one of them add, and for how many terms."""
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lang in dict.fromkeys(langs):
            rows = batch.filter(pa.array([x == lang for x in langs]))
            terms = rows["terms"].to_numpy()
            n = len(rows["shares"][0])
            every = rows["shares"].flatten().to_numpy().reshape(-1, n)
            there = rows["held"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            value, covered = np.zeros((n, n), dtype=np.int64), np.zeros((n, n), dtype=np.int64)
            step = max(1, _CELLS // n)
            for k in range(n):
                with_k = np.flatnonzero(there[:, k])
                for at in range(0, len(with_k), step):
                    own = with_k[at : at + step]
                    p, m, new = every[own], terms[own, None], ~there[own]
                    one = p[:, k, None]
                    square = (p - one) ** 2
                    value[k] += (m * (square // p)).sum(axis=0)
                    value[:, k] += (m * (square // one) * new).sum(axis=0)
                    covered[k] += m.sum()
                    covered[:, k] += (m * new).sum(axis=0)
            i, j = np.nonzero(covered)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value[i, j]), pa.array(covered[i, j])], names=["lang", "a", "b", "value", "covered"])


def _pairs(met: DataFrame, own: DataFrame, small: bool) -> DataFrame:
    """Divergence of every source from every other of its language."""
    counts = F.map_from_entries(F.transform("column", lambda c: F.struct(c["source"], c["n"])))
    share = lambda held, s: _share(F.coalesce(F.try_element_at(held, s["source"]), F.lit(0)), s["total"], F.col("kinds"))
    both = let(counts, lambda held: F.struct(F.transform("sources", lambda s: share(held, s)).alias("shares"), F.transform("sources", lambda s: F.map_contains_key(held, s["source"])).alias("held")))
    summed = met.select("lang", "terms", both.alias("x")).select("lang", "terms", "x.shares", "x.held").mapInArrow(_pair_sums, "lang string, a int, b int, value bigint, covered bigint")
    found = summed.groupBy(F.col("lang").alias("l"), "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    named = own.select("lang", "source", "kinds", _share(F.lit(0), F.col("total"), F.greatest("kinds", F.lit(1))).alias("p"), place)
    right = named.select(F.col("lang").alias("lang2"), F.col("source").alias("item"), F.col("p").alias("q"), F.col("place").alias("place2"))
    right = F.broadcast(right) if small else right
    every = named.join(right, (F.col("lang") == F.col("lang2")) & (F.col("place") != F.col("place2")))
    met_both = every.join(found, (F.col("lang") == F.col("l")) & (F.col("place") == F.col("a")) & (F.col("place2") == F.col("b")), "left")
    rest = (F.col("kinds") - F.coalesce("covered", F.lit(0))) * _apart(F.col("p"), F.col("q"))
    value = F.coalesce("value", F.lit(0)) + F.when(F.col("kinds") > 0, rest).otherwise(F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return met_both.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value")).withColumn("rank", F.row_number().over(order))


def _terms_of(met: DataFrame, held: DataFrame) -> DataFrame:
    """The terms by which each source stands out of its language."""
    q = _share(F.aggregate("column", F.lit(0).cast("bigint"), lambda s, c: s + c["n"]), F.col("lang_total"), F.col("kinds"))
    totals = F.map_from_entries(F.transform("sources", lambda s: F.struct(s["source"], s["total"])))
    value = lambda b, c: let(_share(c["n"], F.element_at(b["totals"], c["source"]), F.col("kinds")), lambda p: F.when(p > b["q"], _apart(p, b["q"])))
    valued = let(F.struct(q.alias("q"), totals.alias("totals")), lambda b: F.transform("column", lambda c: F.struct(c["source"].alias("source"), value(b, c).alias("value"))))
    found = met.select("lang", "digest", F.filter(valued, lambda x: x["value"].isNotNull()).alias("above")).where(F.size("above") > 0)
    named = held.select("lang", "term", "digest").join(found, ["lang", "digest"]).select("lang", F.col("term").alias("item"), F.explode("above").alias("x"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = named.select("lang", "x.source", F.lit("term").alias("part"), "item", "x.value").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= TOP_TERMS).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")
