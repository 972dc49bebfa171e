"""Line dedup against all pairs of lines."""

import random

from pyspark.sql import functions as F

from platterlake.llm import line_dedup

SCHEMA = "doc_id bigint, text string, line string, at string"


def slow(texts):
    """(doc, line_no) to (kept, earlier matching doc or None) by comparing all lines."""
    found = [(i, n, set(x.split())) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    out = {}
    for k, (i, n, s) in enumerate(found):
        same = [j for j, _, u in found[:k] if s and 5 * len(s & u) >= 4 * len(s | u)]
        out[i, n] = not same
    return out


def slow_links(texts):
    """(doc, line_no) to how many other sets of words match the line's, by comparing all."""
    found = {(i, n): frozenset(x.split()) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))}
    sets = set(found.values()) - {frozenset()}
    many = {s: sum(5 * len(s & u) >= 4 * len(s | u) for u in sets) - 1 for s in sets}
    return {k: many.get(s, 0) for k, s in found.items()}


def texts():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of", "é", "日本"]
    pool = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 12, 20, 30]))) for _ in range(50)]

    def line():
        words = rnd.choice(pool).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            rnd.shuffle(words)
        return "  ".join(words)

    docs = ["\n".join(line() for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    return [*docs, None, "", "\n\n", " ", "a\n\na", " ".join(f"u{i}" for i in range(20_000)), docs[3], "the of " * 3000, "a\tb c\rd", *(" ".join([*(f"v{i}" for i in range(150)), f"x{j % 7}", f"y{j % 3}"]) for j in range(20))]


def test_line_dedup_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], SCHEMA)
    decided = line_dedup.line_dedup(docs)
    got = {(r.doc, r.line_no): r.kept for r in decided.collect() if r.line_no is not None}
    assert got == slow(rows)
    assert {(r.doc, r.line_no): r.links for r in decided.collect() if r.line_no is not None} == slow_links(rows)
    documents = line_dedup.by_document(decided)
    whole = {r.doc: r for r in documents.collect()}
    assert set(whole) == set(range(len(rows)))
    for i, t in enumerate(rows):
        assert whole[i].n_lines == (0 if t is None else len(t.split("\n")))
        assert whole[i].kept_lines == [n for n in range(whole[i].n_lines) if got[i, n]]
    for r in line_dedup.rewrite(docs, documents).collect():
        t = rows[r.row.doc_id]
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if got[r.row.doc_id, n]))


def test_line_dedup_edges(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(None, "a b", "", ""), (3, "a b", "", ""), (3, "a b", "", ""), (None, None, "", "")], SCHEMA)
    got = sorted((str(r.doc), str(r.line_no), r.kept, str(r.match_doc)) for r in line_dedup.line_dedup(rows).collect())
    assert got == [("3", "0", False, "None")] * 2 + [("None", "0", True, "None"), ("None", "None", True, "None")]


def test_classes_that_share_a_signature(spark):
    """Signatures that agree by chance must not hide a link or add a class that lacks the word."""
    rows = [" ".join(f"p{j}" for j in range(30) if j != i % 30) + f" q{i}" for i in range(150)] * 2
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc: (r.kept, r.links) for r in line_dedup.line_dedup(docs).collect()}
    kept, links = slow(rows), slow_links(rows)
    assert got == {i: (kept[i, 0], links[i, 0]) for i in range(len(rows))}


def test_tiles_cut_by_size_lose_no_link(spark, monkeypatch):
    """Lines of every size from 1 to 60, each the one before and a word, meet at the ends of the size ranges: 4 to 5, 8 to 10 and so on."""
    monkeypatch.setattr(line_dedup, "CUT_WORDS", 0)
    found = ["\n".join(" ".join(f"c{i}" for i in range(n)) for n in range(1, 61)), *texts()[:20]]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id bigint, text string")
    got = line_dedup.line_dedup(docs).collect()
    assert {(r.doc, r.line_no): r.links for r in got} == slow_links(found)
    assert {(r.doc, r.line_no): r.kept for r in got if found[r.doc].split("\n")[r.line_no].strip()} == {k: v for k, v in slow(found).items() if found[k[0]].split("\n")[k[1]].strip()}


def test_rarest_words_before_tell_pairs_that_were_compared(spark):
    """Plain numbers decide for near copies, which share most words; they never turn away a pair that shares no word before this one."""
    rnd = random.Random(4)
    found = [(rnd.sample([0, -1, *range(1, 12)], 6), rnd.randint(1, 6)) for _ in range(60)]
    rows = spark.createDataFrame(found, "prefix array<int>, place int").select("prefix", "place", *line_dedup._before(F.col("place")))
    a, b = ({c: F.col(f"{s}.{c}") for c in ("l1", "l2", "r1", "r2")} for s in "ab")
    both = rows.alias("a").crossJoin(rows.alias("b")).select("a.prefix", "a.place", F.col("b.prefix").alias("other"), F.col("b.place").alias("at"), line_dedup._anew(a, b).alias("anew"))
    got = both.collect()
    assert len(got) == 3600
    for r in got:
        assert r.anew == (not set(r.prefix[: r.place - 1][:2]) & set(r.other[: r.at - 1][:2]))
