"""Exact dedup, decontamination, BPE and SimHash against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from platterlake.llm import bpe, decontaminate, exact_dedup, simhash

SCHEMA = "doc_id bigint, text string, keep_id string, row string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


TEXTS = ["a b c", "a b c", None, "", "z" * 40_000, "A b c", "a b c ", None, "ünï çode", "the end", "a b c"]


def test_perfect_hash_is_minimal_and_total():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    levels = exact_dedup.build_hash(digests)
    assert sorted(exact_dedup.find_slots(levels, digests)) == list(range(5000))


def test_exact_dedup_brute_force(spark):
    got = {r.id: r for r in exact_dedup.exact_dedup(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert bytes(got[i].digest) == hashlib.sha256((t or "").encode()).digest()


def test_exact_dedup_history_and_edges(spark):
    old = frame(spark, ["p", "q", "q"], 100)
    got = {r.id: r for r in exact_dedup.exact_dedup(frame(spark, ["q", "r", "r"]), history=old).collect()}
    assert (got[0].keep_id, got[0].group_size, got[0].kept) == (102, 3, False)
    assert (got[1].keep_id, got[2].kept) == (2, True)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    rows = spark.createDataFrame([(None, "t", "", ""), (3, "t", "", ""), (None, "u", "", ""), (3, "t", "", "")], SCHEMA)
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()) == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in [*TEXTS, "One two three\x0bfour FIVE six", " ".join(f"w{i % 700}" for i in range(70_000))]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def closure(fps, ids, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(fps))]


@pytest.mark.parametrize("tile", [2048, 4])
def test_links_and_components(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 7, 2**63]
    for _ in range(140):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 4)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    fps = sorted(set(fps), key=fps.index)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = closure(fps, signed)
    assert [got.get(s, s) for s in signed] == want


def test_near_dedup_edges(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [*TEXTS, base, base.replace("word7 ", "other "), base + " more"]
    got = {r.id: r for r in simhash.near_dedup(frame(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].component_id for i in range(len(texts))] == closure(fps, list(range(len(texts))))
    assert simhash.near_dedup(frame(spark, [])).collect() == []
    rows = spark.createDataFrame([(None, "t", "", ""), (3, "t", "", ""), (3, "t", "", ""), (None, "u", "", "")], SCHEMA)
    assert sorted(str(r.component_id) for r in simhash.near_dedup(rows).collect()) == ["3", "3", "3", "None"]


def slow_hits(texts, items):
    docs = [[w.decode() for w in decontaminate.words(t)] for t in texts]
    out = []
    for d in docs:
        hit, names = set(), set()
        for name, t in items:
            w = [x.decode() for x in decontaminate.words(t)]
            k = min(13, len(w))
            for s in range(len(w) - k + 1) if w else ():
                for p in range(len(d) - k + 1):
                    if d[p : p + k] == w[s : s + k]:
                        hit.update(range(p, p + k))
                        names.add(str(name))
        out.append((len(d), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(d)))
    return out


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontaminate_brute_force(spark, block_words):
    rnd = random.Random(3)
    vocab = "alpha beta gamma delta the of and x1 ÉTÉ naïve".split()
    item = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((40, 25, 13, 12, 3, 2, 20))] + [(7, None), (8, "--"), (9, "the the the the the"), (10, item(30))]
    items += [(11, items[0][1].upper().replace("É", "É")), (10, items[10][1])]
    texts = ["", None, "??", item(5), items[0][1], item(30) + ", " + items[1][1].replace(" ", "; ") + item(9), items[2][1][:-1], "the " * 300]
    texts += [" ".join(items[0][1].split()[3:20] + item(500).split()), items[10][1] + " " + items[10][1], item(2000)]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.row.doc_id: r for r in decontaminate.verdict(decontaminate.decontaminate(docs, bench, block_words=block_words)).collect()}
    for i, (n, hit, names, bad) in enumerate(slow_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, sorted(got[i].items), got[i].contaminated) == (n, hit, names, bad), i
    assert got[0].row.keep_id == "x"


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in decontaminate.verdict(decontaminate.decontaminate(frame(spark, ["a b"]), none)).collect()] == [0]
    assert decontaminate.verdict(decontaminate.decontaminate(frame(spark, []), none)).collect() == []


def hard_texts():
    rnd = random.Random(1)
    words = ["the", "Überall", "naïve", "x", "don't", "1234", "  ", "\n\n", "\t", "日本語", "🙂", "<|endoftext|>", " ", "=====", "éé", "a" * 50]
    out = ["", "a", "<|endoftext|>", "a" * 9000, " " * 5000, "\n" * 3000, "é" * 3000, "ab" * 4000]
    for n in (10, 200, 2000, 4000):
        out += ["".join(rnd.choice(words) + rnd.choice([" ", " ", "", "\n", "  "]) for _ in range(n)) for _ in range(4)]
    plain = "And therhean is the is esndha reedes ha. On the password=abc123 and (so) on; "
    out.append("".join(rnd.choice(plain.split()) + " " for _ in range(30_000)))
    out.append("".join(rnd.choice("<|endoftext|> ab") for _ in range(8000)) + "<|endoftext|>" * 300)
    return out


def test_bpe_equals_library():
    files = bpe.public_files()
    own = bpe.Codec(*files)
    for text in hard_texts() * 2:
        want = own.slow.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert own.decode(want) == own.slow.decode(want, skip_special_tokens=False)
    assert own.reused > 0
    assert own.decode([0, 255, 200]) == own.slow.decode([0, 255, 200], skip_special_tokens=False)


def test_bpe_query_rows(spark):
    files = bpe.public_files()
    got = {r.id: r for r in bpe.encode_decode(frame(spark, [None, "", "two words"]), files).collect()}
    assert [got[i].n_tokens for i in range(3)] == [0, 0, 2]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = frame(spark, ["two words é"]).select(bpe.encode_udf(files)("text").alias("i"))
    assert ids.select(bpe.decode_udf(files)("i")).first()[0] == "two words é"
    assert bpe.encode_decode(frame(spark, []), files).collect() == []


@pytest.mark.parametrize("shape", ["odd id", "no ids", "small history", "large history"])
def test_no_bucket_holds_more_than_its_share(spark, monkeypatch, shape):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 100)
    seen = []
    look_up = exact_dedup.look_up

    def watched(fresh, index, buckets):
        seen.append(max([r["count"] for r in fresh.groupBy(exact_dedup._bucket(buckets)).count().collect()], default=0))
        return look_up(fresh, index, buckets)

    monkeypatch.setattr(exact_dedup, "look_up", watched)
    n = 3000
    rows = [(None if shape == "no ids" else i, f"t{i % 2900}") for i in range(n)] + [(-(10**15) if shape == "odd id" else None, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    history = {"small history": docs.where("doc_id = 5"), "large history": docs.union(docs).selectExpr("doc_id + 100000 AS doc_id", "text || doc_id % 2 AS text")}.get(shape)
    found = exact_dedup.exact_dedup(docs, history)
    assert found.count() == n + 1 and seen[0] <= 400
    times = Counter(r.text for r in (docs if history is None else docs.unionByName(history)).collect())
    want = Counter((hashlib.sha256(t.encode()).digest(), times[t]) for _, t in rows)
    assert Counter((bytes(r.digest), r.group_size) for r in found.collect()) == want
