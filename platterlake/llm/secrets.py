"""Secret scans behind a trigram inverted index, all in SQL functions.

From each rule's regular expression a Boolean query over trigrams is derived: a
run of literals needs all its trigrams, alternatives need one of theirs, and what
can be left out or vary freely needs nothing. Texts fall into ``SLOTS`` slots by
their hash. The index holds, for each trigram of the rules and each block of slots,
the sorted list of slots with a text that has it, folded to lower case. A query in
disjunctive form intersects the posting lists of each of its clauses and unites
the clauses; what remains for a rule is a bitmap over the slots (2 MB at most).

The bitmaps are broadcast, and only texts in a candidate slot are verified with
the rule's expression; texts that share a slot by chance fail there. A rule without
a mandatory trigram scans every text. Nothing but slots and trigrams is shuffled.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import listed, matches

#: Strings that a run of literals may stand for before it is cut.
_MOST_STRINGS = 16
#: Slots that texts fall into by hash, and slots of one block, which one posting list and one bitmap cover.
SLOTS, BLOCK = 1 << 24, 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A kind, its pattern, and the least length (code points) of a group of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then the added ones, in the order of their kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("access_temporary", r"\bASIA[A-Z0-9]{16}\b"),
    Rule("bearer", r"\bBearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("code_host", r"\bgh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("maps_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"\b[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("signed_claims", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._%+-]{1,64}:[^\s:/@]{3,64}@"),
)

#: A query: ("all", parts), ("any", parts), or a trigram. No parts in "all": always true.
Query = tuple | str


def _exact(node: tuple) -> set[str] | None:
    """Every string an element can match, folded; None if too many or unbounded."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).translate(str.maketrans(_UPPER, _LOWER))}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= _MOST_STRINGS:
        return set().union(*(_exact(x) for x in arg))
    if op is sre.SUBPATTERN:
        return _joined(arg[3])
    if op is sre.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[:2] == (0, 1):
        inner = _joined(arg[2])
        return None if inner is None else {"", *inner}
    if op is sre.AT:
        return {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _strings(found: set[str]) -> list[Query]:
    """What a text needs that holds one of these strings."""
    if any(len(s) < 3 for s in found):
        return []
    return [("any", [("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])]


def _needs(nodes) -> list[Query]:
    run, out = {""}, []
    for op, arg in nodes:
        more = _exact((op, arg))
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        out += _strings(run)
        run = {""}
        if more is not None and len(more) <= _MOST_STRINGS:
            run = more
        elif op is sre.SUBPATTERN:
            out += _needs(arg[3])
        elif op is sre.BRANCH:
            parts = [_needs(x) for x in arg[1]]
            out += [("any", [("all", p) for p in parts])] if all(parts) else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0]:
            out += _needs(arg[2])
    return out + _strings(run)


def trigram_query(pattern: str) -> Query:
    """The trigrams, folded to lower case, that any match must hold."""
    return ("all", _needs(parser.parse(pattern)))


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def clauses(query: Query) -> list[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that it needs together; no trigram in one: always true."""
    if isinstance(query, str):
        return [frozenset({query})]
    parts = [clauses(x) for x in query[1]]
    if query[0] == "any":
        return list(dict.fromkeys(c for p in parts for c in p))
    return list(dict.fromkeys(frozenset().union(*chosen) for chosen in product(*parts)))


def _indexed(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """By kind, the clauses of the rules that the index can serve."""
    found = {r.kind: clauses(trigram_query(r.pattern)) for r in rules}
    return {k: c for k, c in found.items() if all(c)}


def _slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SLOTS))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text") -> DataFrame:
    """(gram, block, places): for each trigram of the rules and block of slots, the places in it, sorted, with a text that has it."""
    grams = sorted(set().union(*(c for cs in _indexed(rules).values() for c in cs)))
    text = F.col(text_col)
    slotted = docs.select(_slot(text).alias("slot"), F.translate(text, _UPPER, _LOWER).alias("folded"))
    held = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams), F.lit(None).cast("string")))
    each = slotted.select("slot", F.explode(held).alias("gram")).select("gram", F.floor(F.col("slot") / BLOCK).cast("int").alias("block"), (F.col("slot") % BLOCK).cast("int").alias("place"))
    return each.distinct().groupBy("gram", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))


def candidates(posted: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(block, bits): for each block of slots a map from kind to the bitmap of the slots that satisfy its query."""
    table = [(g, kind, i, len(c)) for kind, cs in _indexed(rules).items() for i, c in enumerate(cs) for g in sorted(c)]
    wanted = posted.sparkSession.createDataFrame(table, "gram string, kind string, clause int, needs int")
    lists = posted.join(F.broadcast(wanted), "gram").groupBy("kind", "clause", "needs", "block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("needs"))
    met = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.element_at("lists", 1), F.array_intersect)
    places = lists.select("kind", "block", F.explode(met).alias("place"))
    maps = places.groupBy("kind", "block").agg(F.bitmap_construct_agg(F.col("place").cast("bigint")).alias("bits"))
    return maps.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("kind", "bits"))).alias("bits"))


def _candidate(bits: Column, kind: str, slot: Column) -> Column:
    """Whether a slot's bit is set for a kind."""
    place = slot % BLOCK
    byte = F.substring(F.try_element_at(bits, F.lit(kind)), F.floor(place / 8).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))
    return F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(bit) != 0, F.lit(False))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, text_col: str = "text") -> DataFrame:
    """(row, base_spans, spans) of every row; spans are array<struct<start, k, kind, end>>.

    Base spans are in order of start, then of kind as listed. ``spans`` are the
    base ones and those of the added rules. Places count code points, ends are
    exclusive. A null or empty text has no spans; an empty table gives an empty
    result. The row's other columns pass untouched, so names, nulls and repeated
    rows there do not matter. The time for a text is linear in its length, and in
    its spans but for a sort.
    """
    rules = base + added
    served = _indexed(rules)
    packed = docs.select(F.struct("*").alias("row"))
    text = packed["row"].getField(text_col)
    placed = packed.withColumn("slot", _slot(text)).withColumn("block", F.floor(F.col("slot") / BLOCK).cast("int"))
    # at most SLOTS / BLOCK rows of 4 KB for each served rule
    found = placed.join(F.broadcast(candidates(postings(docs, rules, text_col), rules)), "block", "left")

    def spans(rule: Rule) -> Column:
        got = matches(text, rule.pattern, (lambda m, g: F.length(g) >= rule.least) if rule.least > 1 else None, rule.group)
        tagged = F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(rules.index(rule)).alias("k"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))
        if rule.kind not in served:
            return tagged
        return F.when(_candidate(F.col("bits"), rule.kind, F.col("slot")), tagged).otherwise(F.array().cast("array<struct<start: int, k: int, kind: string, end: int>>"))

    first = found.select("row", F.array_sort(F.flatten(F.array(*map(spans, base)))).alias("base_spans"), F.flatten(F.array(*map(spans, added))).alias("more"))
    none = F.array().cast("array<struct<start: int, k: int, kind: string, end: int>>")
    return first.select("row", F.coalesce("base_spans", none).alias("base_spans"), F.coalesce(F.array_sort(F.concat("base_spans", "more")), none).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[int, int, str, int]]:
    """(start, k, kind, end) by Python's own engine, for tests."""
    found = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(found)


__all__ = ["ADDED", "BASE", "Rule", "brute_force", "candidates", "clauses", "listed", "postings", "scan", "trigram_query"]
