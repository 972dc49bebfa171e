"""The pipeline against brute force on a small fixture."""

import os
import random

import pytest

import corpus_pipeline
from platterlake.llm import bpe, decontaminate, language, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id bigint"


def fixture(spark, folder, texts):
    rows = [(i, t, "en" if i % 5 else None, "s", None if t is None else len(t), "r", 7) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a row twice
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    items = [(0, " ".join(f"quiz{i}" for i in range(20))), (1, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def slow(rows, items):
    """Ids that stay, stage by stage, by definition."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    rows = [(i, t) for t, i in last.items()]
    fps = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    rows = [rows[i] for i in range(len(rows)) if rows[i][0] == min(rows[j][0] for j in range(len(rows)) if group[j] == group[i])]
    grams = [w[s : s + 13] for w in (decontaminate.words(t) for _, t in items) for s in range(len(w) - 12)]
    out = []
    for i, t in rows:
        w = decontaminate.words(t)
        hit = {p + k for p in range(len(w) - 12) for k in range(13) if w[p : p + 13] in grams}
        if not hit or 20 * len(hit) < len(w):
            out.append(i)
    return sorted(out)


def test_run_brute_force(spark, tmp_path):
    base = " ".join(f"word{i} and" for i in range(300))
    quiz = " ".join(f"quiz{i}" for i in range(20))
    texts = [base, base, base + " more", None, "", "12 34", "alpha beta", "alpha beta", "short " + quiz, base.replace("word", "deed") + " " + quiz, "other words here, quite different", "z" * 50_000]
    texts += [f"Seite {i} von allem was " + " ".join(str(i * j) + "te" for j in range(30)) for i in range(20)]
    rows, items = fixture(spark, str(tmp_path), texts)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == slow(rows, items)
    own = bpe.Codec(*bpe.public_files())
    for r in got:
        assert r.exact and r.n_tokens == len(r.ids)
        assert r.ids == own.slow.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    _, _ = fixture(spark, str(tmp_path), ["a b", "c d", "a b"])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
    nulls = spark.createDataFrame([(None,) * 7, (None,) * 7, (None, "x y", None, None, None, None, None)] * 2, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, str(tmp_path)).count() <= 6
    assert corpus_pipeline.drop_copies(spark, nulls, str(tmp_path)).count() == 2


@pytest.mark.parametrize("n_rows", [60, 90, 120, 400])
def test_foreign_documents_are_rejected(spark, n_rows):
    """The rule is the same with 20 labelled documents kept from training and with 130."""
    rnd = random.Random(8)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["str", "ing", "orp", "elk"]}
    text = lambda k, n: " ".join("".join(rnd.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(k := rnd.choice(list(parts)), rnd.randint(1, 60)), k) for i in range(n_rows)]
    han, cyrillic = "人人生而自由在尊严和权利上一律平等", "Все люди рождаются свободными и равными в своем достоинстве и правах"
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"
    foreign = {900: han, 901: cyrillic, 902: polish, 903: text("xx", 2) + " " + han, 904: text("yy", 3) + " " + polish}
    own = {910: text("xx", 20) + " " + han, 911: text("yy", 40) + " " + polish[:16], 912: text("xx", 20) + " " + text("yy", 20), 913: "kalo", 914: text("xx", 9) + " 12 %% !!"}
    extra = [(i, t, None) for i, t in (foreign | own).items()]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {r[0] for r in rows} <= kept
    assert kept - {r[0] for r in rows} == set(own)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]
    assert os.path.isfile(corpus_pipeline.__file__) and language.UNKNOWN == "und"
