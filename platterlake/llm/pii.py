"""Personal data by weak supervision, all in SQL functions.

Candidates are spans of regular expressions. Three labelers vote on each (yes,
no, or abstain): the form of the span itself, a gazetteer of words before it, and
its context (what touches it). Votes fall into a bounded number of patterns, so
the corpus is reduced to one small table of pattern counts, over all documents.
Expectation-maximisation on that table estimates each labeler's reliability on each
kind and the share of true spans, without labels. Its posteriors then train the final span
classifier, a logistic regression over the kind, the votes and the length, whose
score is an SQL expression again.

Spans of the four base kinds always stay; a candidate of another kind is added
where the classifier says yes and it touches no base span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import SPAN, listed, matches, running

# Patterns of the base kinds, as possessive equivalents that do not
# retry inside a run of their own first class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Patterns of the added kinds, in the order of their names.
ADDED = {
    "address": r"\b[0-9]{1,5}\x20[A-Z][a-z]{2,20}\x20(?:Street|Avenue|Road|Lane|Boulevard|Straße|Strasse|Calle)\b",
    "email_spelled": r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+()\x20.-])\x20?(?:\([0-9]{3}\)\x20|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}
#: Words that announce personal data, and words that announce other numbers.
CUES = ("account", "address", "call", "contact", "email", "fax", "iban", "id", "mail", "mobile", "phone", "reach", "ssn", "tel", "telephone", "wohnt", "lives")
COUNTER_CUES = ("build", "chapter", "isbn", "issue", "license", "page", "part", "release", "revision", "serial", "v", "version")
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(ADDED)
LABELERS = ("form", "gazetteer", "context")
#: What all kinds together say about a labeler counts as much as so many spans of one kind.
POOLED_SPANS = 20.0
#: Lengths of a span fall into this many classes of this width.
LENGTHS, LENGTH_STEP = 4, 8
_REST = "form: int, gazetteer: int, context: int, long: int"
_VOTED = f"array<struct<k: int, kind: string, start: int, end: int, {_REST}>>"


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """The four base kinds as span arrays, each guarded by what it cannot do without."""
    none = F.array().cast(SPAN)
    kinds = {
        "email": (F.contains(text, F.lit("@")), matches(text, EMAIL)),
        "ip": (F.contains(text, F.lit(".")), matches(text, IP, lambda m, _: F.regexp_like(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")))),
        "card": (F.lit(True), matches(text, CARD, lambda m, _: _digits(m).between(13, 19) & _luhn(m))),
        "phone": (F.contains(text, F.lit("+")), matches(text, PHONE, lambda m, _: _digits(m).between(9, 15))),
    }
    return {k: F.when(guard, spans).otherwise(none) for k, (guard, spans) in kinds.items()}


def _form(kind: str, m: Column) -> Column:
    """Vote of the span's own form."""
    plain = {
        "email": F.regexp_like(m, F.lit(r"\.[A-Za-z]{2,}$")),
        "ip": ~F.regexp_like(m, F.lit(r"^(?:0|255)\.")),
        "card": F.regexp_like(m, F.lit("^[2-6]")),
        "phone": _digits(m) >= 10,
        "iban": F.length(F.regexp_replace(m, " ", "")).between(15, 34),
        "national_id": ~F.regexp_like(m, F.lit("^(?:000|666|9)|-00-|-0000$")),
    }
    return F.when(plain.get(kind, F.lit(True)), 1).otherwise(-1)


def _votes(kind: str, spans: Column) -> Column:
    """Spans of one kind with the labelers' votes: 1 yes, -1 no, 0 abstain."""

    def vote(s: Column) -> Column:
        before, after = F.lower(s["before"]), s["after"]
        cue = F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(CUES)})[^a-z]*$"))
        counter = F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(COUNTER_CUES)})[^a-z]*$"))
        touched = F.regexp_like(F.substring(before, -1, 1), F.lit(r"[\p{L}0-9_/=#]")) | F.regexp_like(after, F.lit(r"[\p{L}0-9_/=#]"))
        gazetteer = F.when(counter, -1).when(cue, 1).otherwise(0)
        long = F.least(F.floor((s["end"] - s["start"]) / LENGTH_STEP), F.lit(LENGTHS - 1)).cast("int")
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _form(kind, s["m"]).alias("form"), gazetteer.alias("gazetteer"), F.when(touched, -1).otherwise(1).alias("context"), long.alias("long"))

    return F.transform(spans, vote).cast(_VOTED)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, voted): the row as it was, and all candidate spans with votes, in order of kind and start."""
    packed = docs.select(F.struct("*").alias("row"))
    text = packed["row"].getField(text_col)
    found = base_spans(text) | {k: matches(text, p) for k, p in ADDED.items()}
    trimmed = {k: F.transform(s, _without_edge) if k == "phone_local" else s for k, s in found.items()}
    return packed.select("row", F.coalesce(F.flatten(F.array(*(_votes(k, s) for k, s in trimmed.items()))), F.array().cast(_VOTED)).alias("voted"))


def _without_edge(s: Column) -> Column:
    """A span without a leading blank, which only served to see what is before it."""
    blank = F.length(s["m"]) - F.length(F.ltrim(s["m"]))
    before = F.when(blank > 0, F.concat(s["before"], F.lit(" "))).otherwise(s["before"])
    return F.struct((s["start"] + blank).alias("start"), s["end"].alias("end"), F.ltrim(s["m"]).alias("m"), s["g"].alias("g"), before.alias("before"), s["after"].alias("after"))


class Pattern(NamedTuple):
    """One row of the pattern table."""

    kind: str
    votes: tuple[int, ...]
    long: int
    n: int


def patterns(voted: DataFrame) -> list[Pattern]:
    """Counts by kind, votes and length over all documents: at most 9 * 27 * 4 rows."""
    each = voted.select(F.explode("voted").alias("v"))
    rows = each.groupBy("v.kind", *(f"v.{x}" for x in LABELERS), "v.long").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(Pattern(r.kind, tuple(r[x] for x in LABELERS), r.long, r.n) for r in rows)


class Fit(NamedTuple):
    """What expectation-maximisation found: by kind the share of true spans and each labeler's reliability, both over all kinds too, and a posterior for each pattern."""

    share: dict[str, float]
    right: dict[str, list[float]]
    pooled_share: float
    pooled: list[float]
    post: list[float]


def reliabilities(table: list[Pattern], rounds: int = 50) -> Fit:
    """EM over the patterns.

    A labeler that speaks is right with its reliability on that kind, whatever the
    truth is; one that abstains says nothing. Each starts from ``0.8``. What is
    found over all kinds is smoothed by one span's worth of that, and what is found
    on one kind by ``POOLED_SPANS`` of all kinds, so rare kinds lean on the others
    and an empty table keeps the start.
    """
    kinds = sorted({p.kind for p in table})
    pooled_share, pooled = 0.8, [0.8] * len(LABELERS)
    share, right = dict.fromkeys(kinds, 0.8), {k: [0.8] * len(LABELERS) for k in kinds}
    post = [0.8] * len(table)

    def told(rows: list[tuple[Pattern, float]], j: int) -> tuple[float, int]:
        spoke = [(q if p.votes[j] > 0 else 1 - q, p.n) for p, q in rows if p.votes[j]]
        return sum(q * n for q, n in spoke), sum(n for _, n in spoke)

    for _ in range(rounds):
        for i, p in enumerate(table):
            yes, no = math.log(share[p.kind]), math.log(1 - share[p.kind])
            for r, v in zip(right[p.kind], p.votes, strict=True):
                if v:
                    yes += math.log(r if v > 0 else 1 - r)
                    no += math.log(1 - r if v > 0 else r)
            post[i] = 1 / (1 + math.exp(min(50.0, no - yes)))
        each = list(zip(table, post, strict=True))
        pooled_share = min(0.99, (0.8 + sum(q * p.n for p, q in each)) / (1 + sum(p.n for p in table)))
        for j in range(len(LABELERS)):
            true, n = told(each, j)
            pooled[j] = min(0.99, max(0.51, (0.8 + true) / (1 + n)))
        for k in kinds:
            own = [(p, q) for p, q in each if p.kind == k]
            share[k] = min(0.99, max(0.01, (POOLED_SPANS * pooled_share + sum(q * p.n for p, q in own)) / (POOLED_SPANS + sum(p.n for p, _ in own))))
            for j in range(len(LABELERS)):
                true, n = told(own, j)
                right[k][j] = min(0.99, max(0.51, (POOLED_SPANS * pooled[j] + true) / (POOLED_SPANS + n)))
    return Fit(share, right, pooled_share, pooled, post)


def _features(kind: str, votes: tuple[int, ...], long: int) -> list[float]:
    return [1.0, *(float(v) for v in votes), *(float(kind == k) for k in KINDS), *(float(long == x) for x in range(LENGTHS))]


def train(table: list[Pattern], post: list[float], rounds: int = 300, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on the posteriors, by gradient descent."""
    xs = [_features(p.kind, p.votes, p.long) for p in table]
    total = sum(p.n for p in table) or 1
    weights = [0.0] * (1 + len(LABELERS) + len(KINDS) + LENGTHS)
    for _ in range(rounds):
        slope = [decay * w for w in weights]
        for x, p, q in zip(xs, table, post, strict=True):
            wrong = (1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True)))) - q) * p.n / total
            for j, v in enumerate(x):
                slope[j] += wrong * v
        weights = [w - s for w, s in zip(weights, slope, strict=True)]
    return weights


def score(v: Column, weights: list[float]) -> Column:
    """The classifier's log-odds for one voted span."""
    bias, rest = weights[0], weights[1:]
    out = F.lit(bias)
    for w, name in zip(rest, LABELERS, strict=False):
        out = out + F.lit(w) * v[name]
    by_kind, by_length = rest[len(LABELERS) : len(LABELERS) + len(KINDS)], rest[len(LABELERS) + len(KINDS) :]
    out = out + F.element_at(F.array(*map(F.lit, by_kind)), v["k"] + 1)
    return out + F.element_at(F.array(*map(F.lit, by_length)), v["long"] + 1)


def without_touching(voted: Column) -> Column:
    """Voted spans in order of kind and start, less the added ones that share a character with a base one.

    In order of their starts, a span meets an earlier base span if one of those
    ends beyond its start, and a later one if the next of those starts before its
    end: two walks along the sorted list.
    """
    n = len(BASE)
    kind = f"struct<start: int, end: int, k: int, kind: string, {_REST}, near: boolean>"
    names = ("form", "gazetteer", "context", "long")
    by_start = F.array_sort(F.transform(voted, lambda v: F.struct(v["start"], v["end"], v["k"], v["kind"], *(v[x].alias(x) for x in names))))

    def marked(spans: Column, zero: int, reach: Callable[[Column, Column], Column], met: Callable[[Column, Column], Column], before: bool) -> Column:
        out = lambda s, v: F.struct(*(v[x].alias(x) for x in ("start", "end", "k", "kind", *names)), ((v["near"] if before else F.lit(False)) | (v["k"] >= n) & met(s, v)).alias("near"))
        return running(spans, zero, lambda s, v: F.when(v["k"] < n, reach(s, v)).otherwise(s), out, kind)

    ahead = marked(by_start, 0, lambda s, v: F.greatest(s, v["end"]), lambda s, v: s > v["start"], False)
    both = marked(F.reverse(ahead), 2**31 - 1, lambda s, v: v["start"], lambda s, v: s < v["end"], True)
    apart = F.transform(F.filter(both, lambda v: ~v["near"]), lambda v: F.struct(*(v[x].alias(x) for x in ("k", "kind", "start", "end", *names))))
    return F.when(F.exists(voted, lambda v: v["k"] >= n), F.array_sort(apart)).otherwise(voted)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, base_spans, spans) of every row; spans are voted structs in order of kind and start.

    The model is trained on all documents and used on all. A null or empty text
    has no spans. The row's other columns pass untouched, so clashing names, nulls
    and repeated rows there do not matter; an empty table gives an empty result.
    The time for a text is linear in its length, and in its spans but for a sort.
    """
    voted = candidates(docs, text_col)
    table = patterns(voted)
    weights = train(table, reliabilities(table).post)
    base = F.filter("voted", lambda v: v["k"] < len(BASE))
    spans = F.filter(without_touching(F.col("voted")), lambda v: (v["k"] < len(BASE)) | (score(v, weights) > 0))
    return voted.select("row", base.alias("base_spans"), spans.alias("spans"))


__all__ = ["ADDED", "BASE", "KINDS", "candidates", "detect", "listed", "patterns", "reliabilities", "train"]
