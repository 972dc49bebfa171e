"""Periodic runs of words by Crochemore's partition refinement, over many texts at once.

Two places of a text are in one class at length l if the same l words begin there.
Classes at length 1 are words; those at l + 1 come from those at l by looking, for
each class that was split last, at the places before its members, for all parts but
the largest (the smaller-half strategy), so that a place is looked at O(log n) times.
Members of a class are linked in the order of their places. Where a member's neighbour
is exactly l places on at length l, a square of period l begins, and its root is not
itself a power; squares of one period at consecutive places make up a run.

The steps of a length are numpy operations over all texts of a batch. Classes never
hold places of two texts, so texts do not disturb each other, and a text leaves the
refinement when no run of the wanted exponent can have so long a period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words refined together, about; a longer text goes by itself.
BATCH_WORDS = 1 << 19
#: Word places of a text that are rewritten before the search: (id as text, how many) to places, or None to leave them.
Places = Callable[[str, int], np.ndarray | None]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, best: struct<start: bigint, length: bigint, period: bigint>, collapsed: string>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


class _Refinement:
    """Classes of places by equal factors, their members in linked order, and links to be looked at by length."""

    def __init__(self, labels: np.ndarray, limit: np.ndarray) -> None:
        """``labels`` give the classes at length 1; ``limit`` is the longest period that matters at a place."""
        n = len(labels)
        self.limit, self.length = limit, 1
        self.of, _ = pd.factorize(labels)
        self.of = self.of.astype(np.int64)
        size = np.bincount(self.of)
        self.kinds = len(size)
        self.members = np.argsort(self.of, kind="stable")  # of a class together, in any order later on
        self.size, self.start = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        self.size[: self.kinds], self.start[: self.kinds] = size, np.cumsum(size) - size
        self.spot = np.empty(n, dtype=np.int64)
        self.spot[self.members] = np.arange(n)
        self.next, self.last = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        self.mark = np.zeros(n, dtype=bool)
        self.due: dict[int, list[np.ndarray]] = {}
        self._link(self.members, self.of[self.members])
        self.small = np.arange(n)

    def _link(self, places: np.ndarray, groups: np.ndarray) -> None:
        """Chain places that are sorted by group and place."""
        same = groups[1:] == groups[:-1]
        a, b = places[:-1][same], places[1:][same]
        self.next[places], self.last[places] = -1, -1
        self.next[a], self.last[b] = b, a
        self._note(a, b)

    def _note(self, a: np.ndarray, b: np.ndarray) -> None:
        """Look at these links when the length has grown to their distance."""
        far = b - a
        ok = (far >= self.length) & (far <= self.limit[a])
        a, far = a[ok], far[ok]
        if not len(a):
            return
        order = np.argsort(far, kind="stable")
        a, far = a[order], far[order]
        cuts = _firsts(far)
        for d, part in zip(far[cuts].tolist(), np.split(a, cuts[1:]), strict=True):
            self.due.setdefault(d, []).append(part)

    def squares(self) -> np.ndarray:
        """Places where a square begins whose period is the present length, sorted."""
        places = self.due.pop(self.length, None)
        if places is None:
            return np.empty(0, dtype=np.int64)
        found = np.unique(np.concatenate(places))
        return found[self.next[found] == found + self.length]

    def grow(self) -> None:
        """Go on to the next length."""
        self.length += 1
        after = self.small[self.small > 0]
        before = after - 1
        home = self.of[before]
        ok = (self.size[home] > 1) & (self.limit[before] >= self.length)  # another text's end is alone in its class
        before, after, home = before[ok], after[ok], home[ok]
        self.small = np.empty(0, dtype=np.int64)
        if not len(before):
            return
        key = home * (self.kinds + 1) + self.of[after]
        order = np.lexsort((before, key))
        before, home, key = before[order], home[order], key[order]
        # the parts of each class, and of a class without a rest its largest part stays where it is
        at = _firsts(key)
        count, owner = np.diff(at, append=len(key)), home[at]
        first = _firsts(owner)
        parts = np.diff(first, append=len(owner))
        rest = self.size[owner[first]] - np.add.reduceat(count, first)
        whose = np.repeat(np.arange(len(first)), parts)
        largest = np.lexsort((count, whose))[np.cumsum(parts) - 1]
        moves = np.ones(len(at), dtype=bool)
        moves[largest[rest == 0]] = False
        if not moves.any():
            return
        taken = np.repeat(moves, count)
        before, home = before[taken], home[taken]
        count, owner = count[moves], owner[moves]
        self._unlink(before, home)
        new = self.kinds + np.arange(len(count))
        self.kinds += len(count)
        group = np.repeat(new, count)
        self._part(before, home, count, new)
        self.of[before] = group
        self._link(before, group)
        self._choose(owner, count, new)

    def _unlink(self, places: np.ndarray, home: np.ndarray) -> None:
        """Take places out of their chains; what stood around a stretch of them is linked."""
        places = places[np.lexsort((places, home))]
        joined = self.next[places[:-1]] == places[1:]
        heads, tails = places[np.concatenate(([True], ~joined))], places[np.concatenate((~joined, [True]))]
        a, b = self.last[heads], self.next[tails]
        self.next[a[a >= 0]] = b[a >= 0]
        self.last[b[b >= 0]] = a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self._note(a[both], b[both])

    def _part(self, places: np.ndarray, home: np.ndarray, count: np.ndarray, new: np.ndarray) -> None:
        """Move places, sorted by class and part, to the end of their class's members, which becomes their own."""
        first = _firsts(home)
        classes, n = home[first], np.diff(first, append=len(home))
        zone_start = self.start[classes] + self.size[classes] - n
        zone = _ranges(zone_start, n)
        self.mark[places] = True
        held = self.members[zone]
        stay = held[~self.mark[held]]
        self.mark[places] = False
        spots = self.spot[places]
        free = spots[spots < np.repeat(zone_start, n)]
        self.members[free], self.spot[stay] = stay, free
        self.members[zone], self.spot[places] = places, zone
        self.size[classes] -= n
        self.size[new] = count
        self.start[new] = zone[np.cumsum(count) - count]

    def _choose(self, owner: np.ndarray, count: np.ndarray, new: np.ndarray) -> None:
        """All parts but the largest of each class that was split are looked at next."""
        first = _firsts(owner)
        parts = np.diff(first, append=len(owner))
        whose = np.repeat(np.arange(len(first)), parts)
        largest = np.lexsort((count, whose))[np.cumsum(parts) - 1]
        rest = owner[first]
        smaller = self.size[rest] < count[largest]
        looked = np.ones(len(owner), dtype=bool)
        looked[largest[smaller]] = False
        classes = np.concatenate((new[looked], rest[smaller]))
        self.small = self.members[_ranges(self.start[classes], self.size[classes])]


def runs(texts: list[np.ndarray], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """For each text, as numbers of words, its runs (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if not sizes.sum():
        return out
    firsts = np.cumsum(sizes + 1) - sizes - 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    end = firsts + sizes
    labels = np.zeros(len(text), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[end] = False
    labels[inside] = np.concatenate(texts)
    wide = int(labels.max()) + 2
    labels[end] = wide - 1
    limit = np.repeat(np.where(sizes >= least_words, sizes // least_periods, 0), sizes + 1)
    state, most = _Refinement(text * wide + labels, limit), int(limit.max())
    found = []
    while state.length <= most and (len(state.small) or state.due):
        at, q = state.squares(), state.length
        if len(at):
            cuts = _firsts(at - np.arange(len(at)))
            start = at[cuts]
            length = at[np.append(cuts[1:], len(at)) - 1] - start + 2 * q
            ok = length >= max(least_words, least_periods * q)
            found += [(int(text[s]), int(s - firsts[text[s]]), int(n), q) for s, n in zip(start[ok], length[ok], strict=True)]
        state.grow()
    for k, s, n, q in sorted(found):
        out[k].append((s, n, q))
    return out


def collapse(n_words: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    kept = np.ones(n_words, dtype=bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return np.flatnonzero(kept)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; the first, then the one of the shortest period, of those with as many."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _search(ids: list[str], texts: list[bytes], places: Places | None, least_words: int, least_periods: int) -> list[dict]:
    words = [t.split() for t in texts]
    if places is not None:
        moved = [places(i, len(w)) for i, w in zip(ids, words, strict=True)]
        words = [w if m is None else [w[k] for k in m.tolist()] for w, m in zip(words, moved, strict=True)]
    code: dict[bytes, int] = {}
    for w in words:
        code.update(dict.fromkeys(w))
    code = dict(zip(code, range(len(code)), strict=True))
    coded = [np.fromiter(map(code.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]
    out = []
    for w, found in zip(words, runs(coded, least_words, least_periods), strict=True):
        kept = [w[k] for k in collapse(len(w), found).tolist()] if found else w
        named = [{"start": a, "length": b, "period": c} for a, b, c in found]
        best = strongest(found)
        out.append({"n_words": len(w), "runs": named, "best": best and dict(zip(("start", "length", "period"), best, strict=True)), "collapsed": b" ".join(kept).decode("utf-8", "replace")})
    return out


def _batches(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of texts of about the same size, as many as go together."""
    held, total = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if held and total + sizes[k] > 8 * BATCH_WORDS:
            yield held
            held, total = [], 0
        held.append(k)
        total += sizes[k]
    if held:
        yield held


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: Places | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(row, found): the row as it was, and the runs of its text's words.

    Words are split at ASCII white space. A run is a stretch of words of which each
    equals the one ``period`` on, as long as can be, with the smallest such period
    and at least ``least_words`` words and ``least_periods`` periods. ``found`` has
    n_words, runs (start, length, period; by start, then period), best (the most
    periods; null without runs) and collapsed, the words joined by one space without
    those that a run repeats. ``places`` may rewrite a text's words first.

    A null or empty text has no words and no runs; a null id is the empty text for
    ``places``. Each row is judged by itself, so repeated rows and hot keys need no
    care, and nothing is shuffled. An empty table gives an empty result.
    """

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            names = [x or "" for x in ids.to_pylist()]
            data = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
            out: list[dict | None] = [None] * len(data)
            for part in _batches([len(x) for x in data]):  # bytes are at most about eight a word
                for k, x in zip(part, _search([names[k] for k in part], [data[k] for k in part], places, least_words, least_periods), strict=True):
                    out[k] = x
            yield pa.array(out, _FOUND_ARROW)

    packed = docs.select(F.struct("*").alias("row"))
    return packed.select("row", run(packed["row"].getField(id_col).cast("string"), packed["row"].getField(text_col).cast("string")).alias("found"))
