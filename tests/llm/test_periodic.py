"""Runs by refinement against every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from platterlake.llm import periodic, queries

SCHEMA = "doc_id bigint, text string, row string, found int"


def slow(words, least=24, periods=3):
    """Every stretch that is as long as a period lets it be, if that is its smallest period."""
    out, n = [], len(words)
    for q in range(1, n // periods + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            length = b - a + q
            if b > a and length >= max(least, periods * q):
                own = words[a : a + length]
                if not any(all(own[k] == own[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((a, length, q))
            a = b + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_random(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            root = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
            words[rng.randint(0, len(words)) : 0] = (root * 9)[: rng.randint(2, 40)]
        texts.append(words)
    for least, periods in ((24, 3), (4, 2), (6, 3)):
        assert periodic.runs([np.array(w, dtype=np.int64) for w in texts], least, periods) == [slow(w, least, periods) for w in texts]


def test_shapes():
    fib = [0], [0, 1]
    while len(fib[-1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    texts = [[], [5], [5] * 23, [5] * 24, [5] * 400, [1, 2] * 100 + [1], list(range(50)) * 3, list(range(50)) * 2 + list(range(49)), fib[1], [1] * 30 + [2] * 30]
    assert periodic.runs([np.array(w, dtype=np.int64) for w in texts]) == [slow(w) for w in texts]
    assert periodic.runs([np.array(fib[1])], 2, 2) == [slow(fib[1], 2, 2)]


def test_long_period_is_not_quadratic():
    words = np.arange(60_000) % 20_000
    assert periodic.runs([words, np.zeros(60_000, dtype=np.int64)]) == [[(0, 60_000, 20_000)], [(0, 60_000, 1)]]


def test_table(spark):
    rows = [(1, "a b " * 15, "x", 1), (1, "a b " * 15, "x", 1), (2, None, None, None), (3, "", None, None), (None, "\u000bq\tÄ\n" * 30 + "z", "x", 2), (4, "w" * 100_000, None, 1)]
    got = [(r.row.doc_id, r.row.row, r.found) for r in periodic.find(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 6 and sum(i == 1 for i, _, _ in got) == 2
    by = {i: f for i, _, f in got}
    assert [tuple(x) for x in by[1].runs] == [(0, 30, 2)] and by[1].collapsed == "a b" and tuple(by[1].best) == (0, 30, 2)
    assert by[2].n_words == by[3].n_words == 0 and by[2].best is None and by[2].collapsed == ""
    assert [tuple(x) for x in by[None].runs] == [(0, 60, 2)] and by[None].collapsed == "q Ä z"
    assert by[4].n_words == 1 and by[4].runs == []
    assert periodic.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strongest_is_exact():
    assert periodic.strongest([(5, 31, 3), (0, 62, 6), (9, 31, 3)]) == (0, 62, 6)
    assert periodic.strongest([]) is None


def test_query(spark):
    folder, sha = "/root/testdata/sf0.001", lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_periodic(spark, folder).collect()}
    assert set(got) == set(texts)
    with_runs = 0
    for i, t in texts.items():
        w = [x.decode() for x in (t or "").encode().split()]
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 2500:
            continue  # the slow version takes time with the square; others are long enough
        found, r = slow(w), got[i]
        with_runs += bool(found)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in found)) and r.collapsed_sha256 == sha(" ".join(kept))
    assert with_runs > 5
