"""The registered queries over the training-data operators, and their SQL.

Each query applies one operator, with production parameters, to its whole table
and derives the contracted columns from the operator's own results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, exact_dedup, html_text, language, line_dedup, periodic, pii, ppm, secrets, shards, simhash
from ._common import table


def _count(spans: str, kind: str) -> Column:
    """How many spans of a column are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for a null page or one without an article."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of every document among those of equal text; null counts as empty."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; null has no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdict(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stay, and what they match; null has no lines."""
    found = line_dedup.by_document(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(F.col("doc").alias("doc_id"), "n_lines", "n_kept", "n_links", F.sha2(F.array_join(F.transform("kept_lines", lambda i: i.cast("string")), ","), 256).alias("kept_sha256"), "match_docs")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to; null counts as empty."""
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.public_files())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "exact")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text; ``und`` for null or no letter."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("row.doc_id", language.held_out("row.doc_id").alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; null counts as empty."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("base_spans", k) for k in pii.BASE]
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; null counts as empty."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("base_spans", r.kind) for r in secrets.BASE]
    return found.select("row.doc_id", *counts, F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null has no words."""
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law of bytes; null has no bytes."""
    found = shards.shard(table(spark, sf_dir, "documents"), 24)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by the trie and by its words; null counts as empty."""
    found = ppm.score(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def _looped(name: str, n: int) -> np.ndarray | None:
    """Places of a document's words after the contract's rewriting: for one id in ten a tail becomes periodic."""
    h = zlib.crc32(name.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, the strongest one, and the words without repeats; null has no words."""
    found = periodic.find(table(spark, sf_dir, "documents").select("doc_id", "text"), places=_looped)
    listed = F.array_join(F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = [F.col(f"found.best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("(1000 * found.best.length) div found.best.period")
    return found.select("row.doc_id", F.size("found.runs").cast("bigint").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and by which terms; null counts as empty."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_shards": op10_shards,
    "op11_ppm": op11_ppm,
    "op12_periodic": op12_periodic,
    "op13_divergence": op13_divergence,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        i AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
                FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
        grams AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
                  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
                        FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
        hits AS (SELECT doc_id, item_id, k, s FROM grams JOIN win USING (k, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS l
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256,
               coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op13_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM documents),
        g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        kept AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT k) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
                     1 + 1000000000 * (coalesce(n, 0)::HUGEINT + 1) // (total + v)::HUGEINT AS p
              FROM s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + 1000000000 * (sum(n)::HUGEINT + 1) // (t.total + v)::HUGEINT AS q
              FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) t USING (lang)
              GROUP BY lang, term, t.total, v),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
                            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
                 ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
        term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 200""",
}
