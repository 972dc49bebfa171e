"""PPM scores against a slow trie, and what the contract fixes about words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from platterlake.llm import ppm

SCHEMA = "doc_id bigint, text string, block string, g int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def slow(rows, order=ppm.ORDER):
    """(n_tokens, n_known, train_tokens, base, score) of each (id, text), by one trie of dictionaries."""
    texts = [(i, (t or "").translate(LOWER).encode()) for i, t in rows]
    trie, words = defaultdict(Counter), Counter()
    places = lambda t: [((b"\xfe" * order + t)[a : a + order], s) for a, s in enumerate([*t, 256])]
    for i, t in texts:
        if learns(i):
            words.update([*t.split(), None])
            for c, s in places(t):
                for k in range(order + 1):
                    trie[c[order - k :]][s] += 1
    total, kinds, out = sum(words.values()), len(words), []
    for _, t in texts:
        score = 0.0
        for c, s in places(t):
            gone = set()
            for k in range(order, -1, -1):
                left = {x: n for x, n in trie[c[order - k :]].items() if x not in gone}
                mass = sum(left.values()) + len(left)
                if s in left:
                    score += math.log10(left[s] / mass)
                    break
                score += math.log10(len(left) / mass) if left else 0
                gone |= set(left)
            else:
                score -= math.log10(257 - len(gone))
        own = [*t.split(), None]
        out.append((len(own), sum(words[w] > 0 for w in own), total, sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), score))
    return out


def check(spark, rows, order=ppm.ORDER):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.id is not None, r.id or 0, r.n_bytes, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.learn) for r in ppm.score(df, order=order).collect()))
    want = sorted((i is not None, i or 0, len((t or "").encode()), *x, learns(i)) for (i, t), x in zip(rows, slow(rows, order), strict=True))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and a[8] == b[8] and a[6:8] == pytest.approx(b[6:8], rel=1e-9)


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("aabcÄé", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    check(spark, [*rows, (100, None), (101, ""), (102, "A\u000bb c  \n"), (None, "ab ab"), (None, None), (7, rows[7][1])])


@pytest.mark.parametrize("order", [1, 2, 6])
def test_other_orders(spark, order):
    check(spark, [(i, "the cat sat on the mat " * (i % 4) + str(i)) for i in range(25)], order)


def test_blocks_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ppm, "_CHUNK", 7)
    monkeypatch.setattr(ppm, "_SLICE", 5)
    grams = ppm._Grams([b"", b"abcabc", b"x" * 30], 3)
    keys, n = grams.counts()
    values = keys.astype(float)
    cut = grams.totals(keys, values).tolist()
    monkeypatch.setattr(ppm, "_CHUNK", 1 << 20)
    again = ppm._Grams([b"", b"abcabc", b"x" * 30], 3)
    assert (keys.tolist(), n.tolist()) == tuple(x.tolist() for x in again.counts()) and n.sum() == 1 + 7 + 31
    assert again.totals(keys, values).tolist() == cut
    text = b"aa bbbbbbbbbbbb c\n\nd eeee f"
    assert [w for part in ppm.words_of(text) for w in part] == text.split()


def test_many_small_blocks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ppm, "BLOCK_BYTES", 40)
    monkeypatch.setattr(ppm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6), pa.int64()), "text": ["a" * 30, "b" * 30, None, "c" * 100, "", "d"], "learn": [True] * 6})
    out = list(ppm._prepare(2, 2)(iter([batch, batch.slice(0, 0), batch])))
    texts = [(r["block"], r["id"]) for b in out for r in b.to_pylist() if r["shard"] is None]
    assert [i for _, i in texts] == [0, 1, 2, 3, 4, 5] * 2 and len({b for b, _ in texts}) > 5
    assert {r["block"] for b in out for r in b.to_pylist() if r["shard"] is not None} == {b for b, _ in texts}


def test_long_text(spark):
    check(spark, [(1, "word " * 40_000), (2, "y" * 150_000), (3, "word")])


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab", "x", 1)], SCHEMA)
    r = ppm.score(df, learn=F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(-3 * math.log10(257)) and r.base_score == 0
    assert ppm.score(df.where("false")).collect() == []


def test_chances_add_up(spark):
    """In any context the 257 symbols' chances are 1 in all."""
    rows = [(g << 8 | s, n) for g, c in {0x616263: [(97, 3), (98, 1)], 0x7A6263: [(99, 2)], 0: [(100, 1)]}.items() for s, n in c]
    asked = {g << 8 | s: 0 for g in (0x616263, 0x7A6263, 0x7A7A63, 0x7A7A7A) for s in range(256)} | dict(rows)
    logs = ppm.log_probabilities(spark.createDataFrame(list(asked.items()), "g bigint, n bigint"), 3).collect()
    for c in (0x616263, 0x7A6263, 0x7A7A63, 0x7A7A7A):
        own = [r.log for r in logs if r.g >> 8 == c]
        assert sum(map(math.exp, own)) == pytest.approx(1 - math.exp(min(own)) if len(own) == 256 else 1)


def test_query(spark):
    from platterlake.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip((i for i, _ in rows), slow(rows), strict=True))
    got = queries.op11_ppm(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(r.doc_id), n, known, total)
        assert (r.base_score, r.score) == pytest.approx((base, score), rel=1e-9)
