"""Language ID with script ranges and Viterbi spans.

Words are runs of letters. The script of a word, by code point ranges, narrows the
languages it may be in to those seen with that script. Within them a word scores
by character n-grams (one to four, word ends included), hashed into a table of
fixed size and counted over labelled documents. Viterbi finds the labels of a
text's words under a penalty for each switch, so a text falls into spans of one
language each; its language is that of most of its letters.

Viterbi runs over all texts of a batch in step, one numpy operation for the n-th
words of all, so the time per word does not depend on Python.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed n-grams of a language.
TABLE = 65_536
ORDERS = (1, 2, 3, 4)
#: Log-likelihood that a change of language costs.
SWITCH = 12.0
#: A word's n-grams count as at most so many.
MOST_GRAMS = 24
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Share of labelled texts that may fit their languages worse than what the least fit is read from.
ODD_SHARE = 0.001
#: By how much, shared among the labelled texts that it is read from, the least fit is lower: few texts say little, none say nothing.
ROOM = 12.0
#: Words of texts that go through Viterbi together.
BATCH_WORDS = 250_000
#: Words whose scores, or counts, a worker keeps.
KEPT_WORDS = 150_000
#: Ranges that numbers are counted in to find one by its rank.
CELLS = 4_096
UNKNOWN = "und"
# First code points of script ranges, and their names.
_RANGES = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
_STARTS = [a for a, _ in _RANGES]
SCRIPTS = tuple(dict.fromkeys(n for _, n in _RANGES))
_WORD = re.compile(r"[^\W\d_]+")


def script(word: str) -> int:
    """Number of the script of a word's first letter."""
    return SCRIPTS.index(_RANGES[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-grams of some words, and the word of each, in order of the words."""
    sizes = np.fromiter((len(w) + 2 for w in found), dtype=np.int64, count=len(found))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(found)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    places, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if n > len(codes):
                break
            h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            mixed = (h + np.uint32(n * 0x7FEB352D % 2**32)) * np.uint32(0x846CA68B)
            fits = room >= n
            places.append((mixed >> np.uint32(16))[fits].astype(np.int64))
            owners.append(of[fits])
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return place[order], owner[order]


class Model:
    """Log-probabilities of n-grams by language, and each script's candidates."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.5) / (totals + 0.5 * TABLE)).astype(np.float32).T.copy() if languages else np.zeros((TABLE, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= SCRIPT_SHARE).T  # by script and language
        self.known = allowed.any(axis=1)  # scripts that some language was seen with
        allowed[~self.known] = True
        self.shut = np.where(allowed, 0, -1000).astype(np.float32)

    def score(self, found: list[str]) -> np.ndarray:
        """(words, languages): each word's score, and far less outside its script's candidates."""
        place, owner = grams(found)
        n = np.bincount(owner, minlength=len(found))
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        total = np.add.reduceat(self.table[place], starts, axis=0)
        total *= (np.minimum(n, MOST_GRAMS) / n)[:, None].astype(np.float32)
        return total + self.shut[[script(w) for w in found]]


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of several texts; ``ids`` are rows of ``scores``."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    k = scores.shape[1]
    came = np.empty((len(ids), k), dtype=np.uint8 if k < 256 else np.int32)
    own = np.arange(k)
    state = scores[ids[begin]].astype(np.float64)
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # texts longer than t
    for t in range(1, int(size[0])):
        a = int(active[t])
        before = state[:a]
        best = before.argmax(axis=1)
        jump = before[np.arange(a), best][:, None] - penalty
        leap = jump > before
        at = begin[:a] + t
        came[at] = np.where(leap, best[:, None], own)
        state[:a] = np.where(leap, jump, before) + scores[ids[at]]
    out = np.empty(len(ids), dtype=np.int32)
    out[begin + size - 1] = state.argmax(axis=1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = begin[: int(active[t])] + t
        out[at - 1] = came[at, out[at]]
    return out


class Labeler:
    """A worker's predictor: the model and the scores of words it has met."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.known = np.zeros(0, dtype=bool)

    def _ids(self, found: list[str]) -> np.ndarray:
        if len(self.places) > KEPT_WORDS:
            self._forget()
        fresh = list(dict.fromkeys(w for w in found if w not in self.places))
        if fresh:
            self.scores = np.concatenate((self.scores, *(self.model.score(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000))))
            self.known = np.concatenate((self.known, self.model.known[[script(w) for w in fresh]]))
            self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh)), strict=True))
        return np.fromiter(map(self.places.__getitem__, found), dtype=np.int64, count=len(found))

    def label(self, texts: list[str | None]) -> list[dict]:
        """lang, score, spans, known, grams and fit of each text."""
        out: list[dict] = [{"lang": UNKNOWN, "score": 0.0, "spans": [], "known": 0.0, "grams": 0, "fit": None} for _ in texts]
        if not self.model.languages:
            return out
        at = 0
        while at < len(texts):
            docs, kept = [], []
            total = 0
            while at < len(texts) and (not docs or total < BATCH_WORDS):
                found = words(texts[at])
                if any(any(map(str.isalpha, w)) for w in found):
                    docs.append(found)
                    kept.append(at)
                    total += len(found)
                at += 1
            if docs:
                self._batch(texts, docs, kept, out)
        return out

    def _batch(self, texts: list[str | None], docs: list[list[str]], kept: list[int], out: list[dict]) -> None:
        flat = [w for d in docs for w in d]
        ids = self._ids(flat)
        sizes = np.array(list(map(len, docs)), dtype=np.int64)
        labels = viterbi(self.scores, ids, sizes, self.penalty)
        letters = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        n = len(self.model.languages)
        of = np.repeat(np.arange(len(docs)), sizes)
        share = np.bincount(of * n + labels, weights=letters, minlength=n * len(docs)).reshape(-1, n)
        best = share.argmax(axis=1)
        known = self.known[ids]
        counted = np.minimum(4 * letters + 2, MOST_GRAMS) * known  # n-grams of one to four in a word with two ends
        each = np.maximum(self.scores[ids, labels] / np.minimum(4 * letters + 2, MOST_GRAMS), -99.0)
        seen, n_grams, total = (np.bincount(of, weights=x, minlength=len(docs)) for x in (letters * known, counted, counted * each))
        order = np.argsort(of * 100.0 + each)  # by text, then by fit
        upto = np.cumsum(counted[order])
        middle = np.searchsorted(upto, np.cumsum(n_grams) - n_grams / 2)
        fit = np.maximum(total / np.maximum(n_grams, 1), each[order[np.minimum(middle, len(order) - 1)]])
        stops = np.cumsum(sizes)
        for i, where in enumerate(kept):
            own = labels[stops[i] - sizes[i] : stops[i]]
            out[where] = {"lang": self.model.languages[best[i]], "score": float(share[i, best[i]] / share[i].sum()), "spans": self._spans(texts[where], own), "known": float(seen[i] / share[i].sum()), "grams": int(n_grams[i]), "fit": float(fit[i]) if n_grams[i] else None}

    def _spans(self, text: str, own: np.ndarray) -> list[dict]:
        changes = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        if len(text.lower()) != len(text):  # places of lower-cased words are not the text's
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            found = [(origin[a], origin[b - 1] + 1) for a, b in (m.span() for m in _WORD.finditer(text.lower()))]
        elif len(changes) == 2:
            end = len(text)
            while not text[end - 1].isalnum() or text[end - 1].isdecimal():
                end -= 1
            return [{"lang": self.model.languages[own[0]], "start": _WORD.search(text).start(), "end": end}]
        else:
            found = [m.span() for m in _WORD.finditer(text.lower())]
        return [{"lang": self.model.languages[own[a]], "start": found[a][0], "end": found[b - 1][1]} for a, b in zip(changes, changes[1:], strict=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    tables: dict[str, np.ndarray] = {}
    kept = 0

    def fold() -> None:
        for lang, counted in seen.items():
            found = list(counted)
            own = tables.setdefault(lang, np.zeros(TABLE + len(SCRIPTS)))
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                place, owner = grams(part)
                weight = np.fromiter((counted[w] for w in part), dtype=np.float64, count=len(part))
                own[:TABLE] += np.bincount(place, weights=weight[owner], minlength=TABLE)
                own[TABLE:] += np.bincount([script(w) for w in part], weights=[counted[w] * len(w) for w in part], minlength=len(SCRIPTS))
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            own = seen.setdefault(lang.as_py(), Counter())
            before = len(own)
            own.update(words(text.as_py()))
            kept += len(own) - before
            if kept > KEPT_WORDS:
                fold()
                kept = 0
    fold()
    for lang, both in tables.items():
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at].astype(np.int64), pa.int64())], names=["lang", "place", "n"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 by three."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def limits(counts: dict[str, int], rows: int) -> dict[str, int]:
    """By language, below which 63-bit hash a row is taken, so that about as many rows of each are: never none, however many there are."""
    return {lang: 2**63 - 1 if n * len(counts) <= rows else max(1, 2**63 * rows // (n * len(counts))) for lang, n in counts.items()}


def sample(ready: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About ``rows`` labelled rows, a language with few of them whole; a row is chosen by its id and text, so null ids do not fare alike."""
    lang = F.col(lang_col).cast("string")
    counts = {r.lang: r.n for r in ready.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return ready
    limit = F.create_map(*(F.lit(x) for pair in limits(counts, rows).items() for x in pair))
    return ready.where(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1) < F.try_element_at(limit, lang))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int | None = None) -> Model:
    """Fit on all labelled rows that are not held out, or on about ``rows`` of them if a caller wants a quick model.

    Rows without a label or a text teach nothing. What comes to the driver is one
    table of fixed size for each language.
    """
    ready = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if rows is not None:
        ready = sample(ready, rows, id_col, text_col, lang_col)
    counts = ready.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "lang string, place int, n bigint")
    found: dict[str, np.ndarray] = {}
    summed = counts.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("place", "n")).alias("c")).toLocalIterator():
        own = found[r.lang] = np.zeros(TABLE + len(SCRIPTS))
        own[[x.place for x in r.c]] = [x.n for x in r.c]
    languages = sorted(found)
    stacked = np.array([found[x] for x in languages]).reshape(len(languages), TABLE + len(SCRIPTS))
    return Model(languages, stacked[:, :TABLE], stacked[:, TABLE:])


_FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("known", T.DoubleType()), T.StructField("grams", T.LongType()), T.StructField("fit", T.DoubleType())])
_SPAN = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)), ("known", pa.float64()), ("grams", pa.int64()), ("fit", pa.float64())])


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """(row, found): the row as it was, and lang, score, spans, known, grams and fit of its text.

    ``score`` is the share of the letters that the language's spans hold. ``known``
    is the share of the letters in scripts that some language was learned with;
    ``grams`` is how many n-grams these letters give, and ``fit`` their mean
    log-likelihood in the languages of their spans, or that of the middle word, with
    half of the n-grams in words that fit no better, if it is more, so neither a few
    odd words nor a foreign passage decide; null if there are none. A text
    that is null or has no letter is ``und`` with score 0 and no spans, as is any
    if no language was learned. Only the text is looked at. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size for each language

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Labeler(shared.value, penalty)
        for texts in batches:
            yield pa.array(own.label(texts.to_pylist()), _FOUND_ARROW)

    packed = docs.select(F.struct("*").alias("row"))
    return packed.select("row", run(packed["row"].getField(text_col).cast("string")).alias("found"))


def ranked(values: DataFrame, rank: int) -> float:
    """The number of rank ``rank``, from 0, in the one column of ``values``, none of them null.

    Counted in CELLS ranges from the least to the greatest, then within the range
    that has it until all in it are equal, so no more than CELLS rows meet.
    """
    v = F.col(values.columns[0])
    bounds = F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")
    found = values.agg(*bounds).first()
    while found.low < found.high:
        cell = F.floor((v - found.low) / (found.high - found.low) * CELLS)
        for found in values.where(v.between(found.low, found.high)).groupBy(cell.alias("cell")).agg(*bounds).orderBy("cell").collect():
            if rank < found.n:
                break
            rank -= found.n
    return found.low


def least_fit(found: DataFrame, model: Model, id_col: str = "doc_id", lang_col: str = "lang") -> float | None:
    """The fit below which a text is in none of the languages, from all labelled rows of ``found``, as ``identify`` gives it, kept from training.

    As far below the fit that all but ODD_SHARE of them reach as that is below
    their mean, less ROOM by their number: the same rule for any number of them.
    None if there is not one. ``found`` is read several times.
    """
    kept = found.where(held_out(f"row.{id_col}") & F.col(f"row.{lang_col}").isin(model.languages) & F.col("found.fit").isNotNull()).select("found.fit")
    got = kept.agg(F.count("fit").alias("n"), F.avg("fit").alias("mean")).first()
    if not got.n:
        return None
    rank, part = divmod((got.n - 1) * ODD_SHARE, 1)
    low = ranked(kept, int(rank))
    if part:
        low += part * (ranked(kept, int(rank) + 1) - low)
    return 2 * low - got.mean - ROOM / got.n


def fits(least: float | None, penalty: float = SWITCH) -> Column:
    """Whether a text's shortfall of the least fit is not beyond what a change of language costs, so short texts get the benefit."""
    return F.lit(True) if least is None else F.coalesce((F.lit(least) - F.col("found.fit")) * F.col("found.grams") <= penalty, F.lit(False))
