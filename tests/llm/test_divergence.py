"""Divergence of sources against counts by hand, and the query against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb

from platterlake.llm import divergence, queries

SCHEMA = "lang string, source string, text string, item string, value int"
FOLDER = "/root/testdata/sf0.001"


def slow(rows, top=divergence.TOP_TERMS):
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen, counts = Counter(), defaultdict(Counter)
        for _, s, w in own:
            seen.update(set(w))
            counts[s].update(w)
        kept = [t for t, n in seen.items() if n >= 3]
        counts = {s: {t: c[t] for t in kept} for s, c in counts.items()}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_small_table(spark, monkeypatch):
    rows = [("a", f"s{k % 5}", f"Alpha beta{k % 3} é-{'x' * (k % 4)} common 12 Common") for k in range(40)]
    rows += [("b", "s1", "one two three"), ("b", "s2", None), (None, None, None), (None, "s", "q q"), ("", "", "q"), ("", "s", "q z z"), ("c", "only", "w")]
    rows += [("h", "hot", "same words again")] * 30 + [("h", "cold", "same words"), ("h", "é", ""), ("a", "quiet", "12 34")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    want = slow(rows)
    assert got(divergence.divergence(df)) == want and {r[2] for r in want} == {"pair", "term"}
    monkeypatch.setattr(divergence, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(divergence, "_HELD", 3)
    assert got(divergence.divergence(df)) == want
    assert divergence.divergence(df.where("false")).collect() == []


def test_ranks_end_at_the_limit(spark):
    rows = [("a", s, " ".join(f"w{'abcdefghij'[k % 10]}{'abcdefghijklmnopqrstuvwxyz'[k // 10]}" for k in range(260) if s == "s" or k % 2)) for s in "sssttt"]
    want = slow(rows)
    assert got(divergence.divergence(spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA))) == want
    assert sum(r[1:3] == ("t", "term") for r in want) == 130 and slow(rows, 10) != want


def test_shares_of_large_counts(spark):
    counts = [0, 1, 8_999_999_999, 9_000_000_000, 5 * 10**15]
    got = spark.createDataFrame([(n, 3 * n, 7) for n in counts], "n bigint, t bigint, k bigint").select(divergence._share(*(divergence.F.col(c) for c in "ntk")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (3 * n + 7) for n in counts]


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 10)
    assert divergence._terms(b"ab cd-ab " * 50 + b"z" * 40) == Counter({b"ab": 100, b"cd": 50, b"z" * 40: 1})


def test_query(spark):
    df = queries.op13_divergence(spark, FOLDER)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "source", "text").collect()
    mine = got(df)
    assert mine == slow([tuple(r) for r in rows])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.sql(queries.ORACLE_SQL["op13_divergence"])
    assert found.columns == df.columns and sorted(found.fetchall()) == mine
