"""Line dedup by an exact set-similarity join, all in SQL functions.

A line is the set of its words; two lines match at a Jaccard similarity of
``THRESHOLD``. Lines with the same set are one class, and only classes are joined.
Words are ordered by rarity: occurrences over all documents are counted in
``BUCKETS`` hash buckets (a table of fixed size), and a word's place is the
frequency class of its bucket, then its hash. A class is probed by the prefix of its
ordered words that any match must touch, without words that occur once in all. The
join is done twice over:

1. By prefix word, on narrow rows. A row is a candidate if some other class shares
   the word and passes the length filter, the positional filter and a filter on
   parity signatures (64 bits, 128 for long lines; each bit is the parity of the
   words that hash to it, so two sets differ in at least as many words as their
   signatures differ in bits). This is a semi-join: it makes no pairs.
2. The words of the candidates' lines are fetched (all lines are scanned once more;
   a bitmap of fixed size, broadcast, keeps most others out of the shuffle, and the
   join decides). The candidates of a prefix word are cut into tiles of bounded size,
   those of a common word by ranges of their sizes too, and tiles of one word and of
   the same or neighbouring ranges are joined: similarity is verified where two classes meet,
   and only a class's number of matches and its earliest one leave the tile. No pair
   is stored, shuffled or made a row.

Two classes that share several prefix words are matched at the rarest one, before
which their prefixes have nothing in common.

A line goes if an earlier line, by document and place, matches it, whether that
one stays or not. Blank lines stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shelve

#: Least similarity, as a fraction.
THRESHOLD = (4, 5)
BUCKETS = 1 << 21
#: Buckets of one row of the table while it is built.
_PART = 4096
#: Bits of a bitmap that keeps rows out of a shuffle: 4 MB, four bits to a byte.
BITMAP_BITS = 1 << 24
#: Lines of so many words have the second half of the signature.
LONG_LINE = 80
#: Words of the lines of one tile, about.
TILE_WORDS = 1 << 16
#: Words of the lines of a prefix word from which its tiles are also cut by size.
CUT_WORDS = 1 << 12
_KEY_BITS = 56


def _spaced(line: Column) -> Column:
    """A line whose blanks are all spaces, so that one fast split finds the words."""
    odd = F.lit(False)
    for blank in "\t\r\x0b\f":
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.regexp_replace(line, "[\t\r\x0b\f]", " ")).otherwise(line)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_hash, line_no, line) of every line; a null text gives one row without a line."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("doc_hash"), text.alias("whole"))
    return rows.select("doc", "doc_hash", F.posexplode_outer(F.split("whole", "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(levels): for each word bucket its frequency class, rare first: quarter octaves of its count, 0 to 127; 0 is one occurrence at most.

    One row of BUCKETS numbers, whatever the input.
    """
    whole = F.replace(_spaced(F.col(text_col).cast("string")), F.lit("\n"), F.lit(" "))
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 64 - _KEY_BITS).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    seen = docs.select(F.explode(F.split(whole, " ")).alias("w")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    level = F.coalesce(F.least(F.floor(4 * F.log2("n")), F.lit(127)), F.lit(0)).cast("tinyint")
    placed = every.join(seen, "bucket", "left").select("bucket", level.alias("level"))
    part = F.floor(F.col("bucket") / _PART).cast("int")
    parts = placed.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("bucket", "level")))["level"].alias("levels"))
    return parts.agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "levels")))["levels"]).alias("levels"))


def _number(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - _KEY_BITS)


def hashed(line: Column, key: Callable[[Column], Column] | None = None, blank: Column | None = None) -> Column:
    """The line's distinct words as 56-bit numbers, or as what ``key`` makes of these, which is ``blank`` for no word.

    What Spark interprets, the functions on single elements, is innermost, so the
    rest is compiled.
    """
    each = F.transform(F.split(_spaced(line), " "), _number)
    if key is not None:
        each = F.transform(each, key)
    return F.array_distinct(F.array_remove(each, _number(F.lit("")) if blank is None else blank))


def token(key: Column) -> Column:
    """A word as the joins know it, from its number or key; words that agree in it only cost a comparison."""
    return F.hash(key.bitwiseAND(F.lit((1 << _KEY_BITS) - 1)))


def keyed(each: DataFrame, levels: DataFrame) -> DataFrame:
    """Lines with their class (x, sig), size, second signature, and prefix from its first word that occurs twice.

    ``levels`` is read once, as a scalar subquery: its numbers are no part of the plan.
    """

    def key(h: Column, numbers: Column) -> Column:
        # never null, so that the numbers are sorted and compared as plain ones
        level = F.coalesce(F.get(numbers, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint"))
        return F.shiftleft(level.cast("bigint"), _KEY_BITS).bitwiseOR(h)

    keys = hashed(F.col("line"), lambda h: key(h, F.col("levels")), key(_number(F.lit("")), levels.scalar()))
    sets = each.withColumn("levels", levels.scalar()).withColumn("keys", F.sort_array(keys))
    size = F.size("keys")
    one = F.lit(1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))
    high = lambda k: F.call_function("shiftleft", F.shiftrightunsigned(k, 6).bitwiseAND(one), k.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda of: F.aggregate("keys", F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(of(k)))
    num, den = THRESHOLD
    prefix = F.slice("keys", 1, F.greatest(size - F.floor((size * num + den - 1) / den).cast("int") + 1, F.lit(0)))
    cut = sets.select("doc", "doc_hash", "line_no", F.xxhash64("keys").alias("x"), size.alias("size"), parity(bit).alias("sig"), F.when(size >= LONG_LINE, parity(high)).otherwise(F.lit(0)).alias("sig2"), prefix.alias("prefix"))
    once = F.size(F.filter("prefix", lambda k: k < F.lit(1 << _KEY_BITS)))
    return cut.withColumn("skip", F.when(F.col("size") > 0, once).otherwise(F.lit(0))).withColumn("prefix", F.transform(F.slice("prefix", F.col("skip") + 1, F.size("prefix")), token))


def classes(keyed_lines: DataFrame) -> DataFrame:
    """One row for each set of words: its first line, how many lines have it, and its prefix."""
    first = F.min(F.struct("doc", "line_no", "doc_hash")).alias("at")
    return keyed_lines.where("size > 0").groupBy("x", "sig").agg(first, F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("size", "sig2", "skip", "prefix")))


def _first() -> Column:
    return F.try_element_at("prefix", F.lit(1))


def _near(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """Whether two classes may match by their sizes and signatures."""
    num, den = THRESHOLD
    both = a["size"] + b["size"]
    one, two = a["sig"].bitwiseXOR(b["sig"]), a["sig2"].bitwiseXOR(b["sig2"])
    long = F.least(a["size"], b["size"]) >= LONG_LINE
    apart = F.when(long, F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two)).otherwise(F.bit_count(one))
    return (den * a["size"] >= num * b["size"]) & (den * b["size"] >= num * a["size"]) & ((num + den) * apart <= (den - num) * both)


def candidates(found: DataFrame) -> DataFrame:
    """(token, sig, size) of the prefix words at which a class of that signature and size has another class to be compared with.

    The positional filter takes a common word for the rarest common one: what is
    before it then adds nothing to the overlap.
    """
    num, den = THRESHOLD
    low = F.lit(0xFFFFFFFF)

    def two(high: Column, low_: Column) -> Column:
        return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low_.cast("bigint").bitwiseAND(low))

    named = found.withColumn("own", F.hash("x"))
    probe = named.select(_first().alias("first"), "size", "skip", "sig", "sig2", "own", F.posexplode("prefix").alias("i", "token"))
    # Few and full columns: this is the widest shuffle.
    rows = probe.select(two(F.col("token"), F.col("first")).alias("words"), two(F.col("own"), F.col("size")).alias("names"), (F.col("skip") + F.col("i")).alias("pos"), "sig", "sig2")
    sides = []
    for s in "ab":
        words, names = F.col(f"{s}.words"), F.col(f"{s}.names")
        sides.append({"token": F.shiftright(words, 32), "first": words.bitwiseAND(low), "names": names, "size": names.bitwiseAND(low), "pos": F.col(f"{s}.pos"), "sig": F.col(f"{s}.sig"), "sig2": F.col(f"{s}.sig2")})
    a, b = sides
    meet = (a["first"] != b["first"]) | (a["token"].bitwiseAND(low) == a["first"])
    position = (num + den) * F.least(a["size"] - a["pos"], b["size"] - b["pos"]) >= num * (a["size"] + b["size"])
    other = (a["sig"] != b["sig"]) | (a["names"] != b["names"])
    pairs = rows.alias("a").join(rows.alias("b"), (a["token"] == b["token"]) & meet & position & _near(a, b) & other, "left_semi")
    met = pairs.select(F.shiftright("words", 32).cast("int").alias("token"), "sig", F.col("names").bitwiseAND(low).cast("int").alias("size")).distinct()
    # Classes that these columns can't tell apart are all compared.
    alike = named.groupBy("sig", "size", "own").count().where("count > 1").select("sig").distinct()
    return met.union(likely(found, alike, "sig").join(alike, "sig", "left_semi").select(F.explode("prefix").alias("token"), "sig", "size")).distinct()


def likely(df: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted``."""
    return flagged(df, wanted, *key).where("likely").drop("likely")


def flagged(df: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``df`` and ``likely``, false only for keys that are not in ``wanted``: a bitmap of BITMAP_BITS / 32,768 rows of 8 KB at most is broadcast."""
    spot = F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS))
    # Spelt in hexadecimal once, so that a row looks at one digit.
    digits = F.hex(F.bitmap_construct_agg(F.bitmap_bit_position(spot))).cast("binary")
    bitmap = wanted.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(digits.alias("digits"))
    placed = df.withColumn("part", F.bitmap_bucket_number(spot)).withColumn("spot", F.bitmap_bit_position(spot).cast("int"))
    place = F.expr("2 * shiftright(spot, 3) + if((spot & 4) = 0, 2, 1)")
    digit = F.ascii(F.substring(F.col("digits"), place, F.lit(1)).cast("string"))
    bit = F.when(digit > 57, digit - 55).otherwise(digit - 48).bitwiseAND(F.expr("shiftleft(1, spot & 3)")) != 0
    return placed.join(F.broadcast(bitmap), "part", "left").withColumn("likely", F.coalesce(bit, F.lit(False))).drop("part", "spot", "digits")


def fetch(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (with ``at``, the place of a line) and that line."""
    place = wanted.select("at.doc", "at.line_no", "at.doc_hash")
    each = likely(lines(docs, id_col, text_col).where("line_no is not null"), place, "doc", "line_no", "doc_hash")
    rows = each.select("doc", "line_no", "doc_hash", "line")
    same = rows["doc"].eqNullSafe(wanted["at.doc"]) & (rows["line_no"] == wanted["at.line_no"]) & rows["doc_hash"].eqNullSafe(wanted["at.doc_hash"])
    return rows.join(wanted, same)


def _before(place: Column) -> list[Column]:
    """l1, l2, r1, r2: the two rarest words of ``prefix`` before a place, as numbers; where there is none, a left one and a right one differ."""
    return [F.when(place > i, F.get("prefix", F.lit(i - 1)).cast("bigint")).otherwise(F.lit(none << 32)).alias(f"{side}{i}") for side, shift in (("l", 0), ("r", 2)) for i in (1, 2) for none in (i + shift,)]


def _anew(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """False only if the classes share one of the two rarest words before this one, so have been compared at a rarer word."""
    return (a["l1"] != b["r1"]) & (a["l2"] != b["r1"]) & (a["l1"] != b["r2"]) & (a["l2"] != b["r2"])


def links(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, sig, at, links, earlier) of each class with matches: its first line, how many other classes, and the earliest line of one."""
    num, den = THRESHOLD
    points = shelve(candidates(found))
    ends = points.select("sig").distinct()
    wanted = likely(found, ends, "sig").join(ends, "sig", "left_semi").select("x", "sig", "at", "size", "sig2", "prefix")
    wanted = shelve(wanted)
    words = fetch(docs, wanted, id_col, text_col).select("x", "sig", "at", "size", "sig2", "prefix", hashed(F.col("line")).alias("keys"))
    # rows that repeat a document repeat its lines
    met = words.repartition("sig", "size").dropDuplicates(["x", "sig", "size"]).join(points, ["sig", "size"])
    place = F.array_position("prefix", F.col("token")).cast("int")
    rows = met.where(place > 0).select("token", F.struct("x", "sig", "sig2", "size", "at", *_before(place), F.slice("prefix", 1, F.greatest(place - 1, F.lit(0))).alias("early"), "keys").alias("row"))
    parts = points.groupBy("token").agg(F.ceil(F.sum("size") / TILE_WORDS).alias("parts"), (F.sum("size") > CUT_WORDS).alias("cut"))
    part = F.pmod(F.xxhash64("row.x", "row.sig"), F.col("parts"))
    # A little wider than what two sizes may differ by, so matches are in the same range or in neighbours.
    band = F.when(F.col("cut"), F.floor(F.log("row.size") / (math.log(den / num) + 1e-6))).otherwise(F.lit(0).cast("bigint"))
    tiles = rows.join(parts, "token").groupBy("token", band.alias("band"), part.alias("part")).agg(F.collect_list("row").alias("rows"))
    near = F.abs(F.col("a.band") - F.col("b.band")) <= 1
    both = tiles.alias("a").join(tiles.alias("b"), (F.col("a.token") == F.col("b.token")) & near).select(F.col("a.rows").alias("left"), F.col("b.rows").alias("right"))

    def matched(a: Column) -> Column:
        """How many rows of the right tile match a row of the left one, and the earliest place before its own."""

        def one(s: Column, b: Column) -> Column:
            both = a["size"] + b["size"]
            # what only one has is little, so this is less work than what both have
            similar = (num + den) * (a["size"] - F.size(F.array_except(a["keys"], b["keys"]))) >= num * both
            other = (a["x"] != b["x"]) | (a["sig"] != b["sig"])
            # What turns most pairs away comes first: near copies meet at many words.
            match = _anew(a, b) & ((num + den) * F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= (den - num) * both) & other & _near(a, b) & ~F.arrays_overlap(a["early"], b["early"]) & similar
            earlier = F.when(b["at"] < a["at"], F.least(s["earlier"], b["at"])).otherwise(s["earlier"])
            return F.when(match, F.struct((s["n"] + 1).alias("n"), earlier.alias("earlier"))).otherwise(s)

        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(place_type).alias("earlier"))
        return F.struct(a["x"].alias("x"), a["sig"].alias("sig"), a["at"].alias("at"), F.aggregate("right", zero, one).alias("met"))

    place_type = found.schema["at"].dataType
    each = both.select(F.explode(F.filter(F.transform("left", matched), lambda m: m["met"]["n"] > 0)).alias("e"))
    return each.groupBy("e.x", "e.sig").agg(F.min("e.at").alias("at"), F.sum("e.met.n").alias("links"), F.min("e.met.earlier").alias("earlier"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_hash, line_no, kept, links, match_doc) of every line of ``docs``.

    ``links`` counts the other classes that the line's class matches; ``match_doc``
    is the document of the earliest match of a line that goes. A null text gives
    one row without a line number; blank lines are kept and match nothing. Ids are
    integers; a null id sorts before all others. A row that repeats an id and its
    text repeats its lines' places, so both fare alike. Other columns are not
    looked at. An empty table gives an empty result.
    """
    each = shelve(keyed(lines(docs, id_col, text_col), shelve(rarity(docs, text_col))))
    found = shelve(classes(each))
    linked = links(docs, found, id_col, text_col)
    # A line that has its class to itself, without a match, needs none of this.
    shared = found.where("n > 1").select("x", "sig", "at", F.lit(0).cast("bigint").alias("links"), F.lit(None).cast(linked.schema["earlier"].dataType).alias("earlier"))
    fate = linked.union(shared).groupBy(F.col("x").alias("c1"), F.col("sig").alias("c2")).agg(F.min("at").alias("at"), F.max("links").alias("links"), F.min("earlier").alias("earlier"))
    fate = shelve(fate)
    lined = flagged(each.select("doc", "doc_hash", "line_no", "x", "sig"), fate.select(F.col("c1").alias("x"), F.col("c2").alias("sig")), "x", "sig")
    placed = lined.where("likely").join(fate, (F.col("x") == F.col("c1")) & (F.col("sig") == F.col("c2")), "left")
    first = F.col("at.doc").eqNullSafe(F.col("doc")) & (F.col("at.line_no") == F.col("line_no")) & F.col("at.doc_hash").eqNullSafe(F.col("doc_hash"))
    kept = F.col("line_no").isNull() | F.col("at").isNull() | (first & F.col("earlier").isNull())
    match = F.when(~kept, F.coalesce("earlier", "at"))
    decided = placed.select("doc", "doc_hash", "line_no", kept.alias("kept"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), match["doc"].alias("match_doc"))
    alone = lined.where(~F.col("likely")).select("doc", "doc_hash", "line_no", F.lit(True).alias("kept"), F.lit(0).cast("bigint").alias("links"), F.lit(None).cast("bigint").alias("match_doc"))
    return decided.union(alone)


def by_document(decided: DataFrame) -> DataFrame:
    """(doc, doc_hash, n_lines, n_kept, n_links, kept_lines, match_docs), a row for each document."""
    no_line = F.col("line_no").isNull()
    return decided.groupBy("doc", "doc_hash").agg(
        F.coalesce(F.max("line_no") + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        F.array_sort(F.collect_set(F.when(F.col("kept") & ~no_line, F.col("line_no")))).alias("kept_lines"),
        F.sum("links").alias("n_links"),
        F.array_sort(F.collect_set("match_doc")).alias("match_docs"),
    ).select("doc", "doc_hash", "n_lines", F.size("kept_lines").cast("bigint").alias("n_kept"), "n_links", "kept_lines", "match_docs")


def rewrite(docs: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text): each row of ``docs`` as it was, and its text without the lines that go."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    both = packed.join(documents, packed.key.eqNullSafe(documents.doc) & (packed.hash == documents.doc_hash))
    text = F.col("row").getField(text_col).cast("string")
    return both.select("row", F.when(text.isNotNull(), F.array_join(F.transform("kept_lines", lambda i: F.get(F.split(text, "\n"), i)), "\n")).alias("text"))
