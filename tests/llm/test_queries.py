"""The registered queries on the smallest tables: contracted columns against slow versions."""

import hashlib
import os
import re
import zlib
from functools import reduce

import pytest
import xxhash

from platterlake.llm import bpe, queries, secrets
from tests.llm.test_line_dedup import slow, slow_links
from tests.llm.test_pii import slow as slow_pii

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, query, key="doc_id"):
    return {r[key]: r for r in query(spark, FOLDER).collect()}


def test_op1(spark):
    got = rows(spark, queries.op1_html, "page_id")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages) and all(got[p.page_id].n_chars == len(got[p.page_id].text) > 0 for p in pages)


def test_op2(spark, texts):
    got, groups = rows(spark, queries.op2_exact_dedup), {}
    for i, t in texts.items():
        groups.setdefault(t or "", []).append(i)
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in got.items()} == {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def test_op3(spark, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    windows: dict[tuple, set] = {}
    for k, w in items.items():
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(k)
    sizes = {len(w) for w in windows}
    for i, r in rows(spark, queries.op3_decontaminate).items():
        doc, hit, met = words(texts[i]), set(), set()
        for n in sizes:
            for a in range(len(doc) - n + 1):
                if (found := windows.get(tuple(doc[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    met |= found
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(doc), len(hit), len(met), sha(",".join(sorted(map(str, met)))))
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(doc))


def test_op4(spark, texts):
    order = sorted(texts)
    kept, links = slow([texts[i] for i in order]), slow_links([texts[i] for i in order])
    got = rows(spark, queries.op4_line_dedup)
    for k, i in enumerate(order):
        own = [n for n in range(got[i].n_lines) if kept[k, n]]
        assert got[i].n_lines == len((texts[i] or "").split("\n")) and got[i].kept_sha256 == sha(",".join(map(str, own)))
        assert got[i].n_links == sum(links[k, n] for n in range(got[i].n_lines))


def test_op5(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.public_files()[0])
    tok.no_truncation()
    tok.no_padding()
    for i, r in rows(spark, queries.op5_bpe).items():
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op6(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = rows(spark, queries.op6_language)
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    judged = [i for i, r in got.items() if r.held_out and langs[i]]
    assert sum(got[i].lang_pred == langs[i] for i in judged) >= 0.95 * len(judged)


def test_op7(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for i, r in rows(spark, queries.op7_pii).items():
        spans = slow_pii(texts[i])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(","))


def test_op8(spark, texts):
    for i, r in rows(spark, queries.op8_secrets).items():
        spans = secrets.brute_force(texts[i], secrets.BASE)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in secrets.brute_force(texts[i], secrets.BASE + secrets.ADDED))


def test_op9(spark, texts):
    prints = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[a : a + 3]), seed=42) for a in range(max(1, len(w) - 2))] if w else []
        prints[i] = reduce(lambda s, b: s | (2 * sum(h >> b & 1 for h in hs) > len(hs)) << b, range(64), 0)
    top = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            low = min(top[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= low < top[i]
            top[i] = min(low, top[i])
    assert {i: (r.fingerprint, r.component_id) for i, r in rows(spark, queries.op9_simhash).items()} == {i: (f"{prints[i]:016x}", top[i]) for i in texts}


def test_op10(spark, texts):
    got, homes, slots, loads = rows(spark, queries.op10_shards), {}, {}, [0] * 24
    for i, r in got.items():
        data = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        homes.setdefault(texts[i] or "", set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, r in got.items():
        groups[texts[i]] = groups.get(texts[i], 0) + r.size
    assert set(slots) <= set(range(24)) and max(loads) <= sum(loads) / 24 + 2 * max(groups.values())
