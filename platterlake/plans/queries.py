"""Registered queries: the archive's relational shapes over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import relational


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def entry_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER, F.col("l_quantity").cast("bigint").alias("byte_length"))
    return relational.running_offsets(lines, ["l_orderkey"], _LINE_ORDER, "byte_length").select("l_orderkey", "l_linenumber", "l_partkey", "byte_length", "byte_offset", "byte_end")


def exact_once_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("revolution"))
    last = lines.groupBy("l_orderkey").agg((F.max("revolution") + 1).alias("n"))
    return relational.coverage(lines, "l_orderkey", "revolution", last, "n")


def _turn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    return relational.running_offsets(turns, ["conv_id"], ["turn"], "n", "start", "end")


def chunks_across_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_ranges(spark, sf_dir)
    total = chunks.groupBy("conv_id").agg(F.max("end").alias("total"))
    entries = relational.segment_plan(total, ["conv_id"], "total", 512).select("conv_id", "start", (F.col("start") + F.col("length")).alias("end"))
    return relational.contained(chunks, entries, "conv_id").select("conv_id", "turn", "start", "end")


def programme_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value")).cast("bigint").alias("samples"))
    found = relational.merged_regions(events, ["user_id"], ["ts", "event_id"], "event_type", "samples")
    return found.select("user_id", "ordinal", "event_type", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), F.col("amount").alias("sample_count"), "n_rows")


def silence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value")).cast("bigint").alias("samples"))
    return relational.merged_silences(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "samples")


def track_gap_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil(F.col("o_totalprice") / 1000).cast("bigint").alias("n"))
    return relational.interleaved(orders, ["o_custkey"], ["o_orderkey"], "n", F.col("o_orderkey") % 3)


def signature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.one_value(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_suppkey")


def barcode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes as read: every third has a wrong check digit, every seventh a digit too few."""
    body = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    digit = (columns.check_digit(body) + F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 9 + 1).otherwise(0)) % 10
    seen = F.when(F.col("p_partkey") % 7 == 0, body).otherwise(F.concat(body, F.lit("-"), digit.cast("string")))
    parts = _table(spark, sf_dir, "part").select("p_partkey", seen.alias("barcode"))
    return parts.select("p_partkey", "barcode", columns.upc(F.col("barcode")).alias("code"), columns.upc(F.col("barcode")).isNotNull().alias("valid"))


def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("total"))
    return relational.segment_plan(docs, ["doc_id"], "total", 1000)


def spec_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    found = relational.checks(lines, ["l_orderkey"], {"discount in range": F.col("l_discount").between(0, 0.1), "quantity positive": F.col("l_quantity") > 0, "returned lines filled": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"), "tax in range": F.col("l_tax").between(0, 0.08)})
    return found.groupBy("label").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def radial_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = entry_offsets(spark, sf_dir).withColumn("total", F.sum("byte_length").over(Window.partitionBy("l_orderkey")))
    share = (F.col("byte_offset") / F.col("total")).cast("double")
    radius = columns.equal_area_radius(share, F.lit(115.0), F.lit(281.0))
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", F.floor(radius * 1e6 + 0.5).cast("bigint").alias("radial_micros"))


def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns labelled by the four-turn track that covers them."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    first = F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4))).alias("first")
    tracks = last.select("conv_id", first).select("conv_id", "first", F.lit(4).alias("n"), (F.col("first") / 4 + 1).cast("bigint").alias("track"))
    return relational.labelled(turns, tracks, "conv_id", "turn", "first", "n", "track").select("conv_id", "turn", "track")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (entry_offsets, exact_once_coverage, chunks_across_entries, programme_regions, silence_spans, track_gap_interleave, signature_sets, barcode_checks, segment_plan, spec_checks, radial_positions, track_labels)
}

_OFFSETS = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS byte_length,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) - CAST(l_quantity AS BIGINT) AS byte_offset,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS byte_end FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"""
_SAMPLES = "SELECT user_id, ts, event_id, event_type, CAST(floor(value) AS BIGINT) AS samples FROM events"

ORACLE_SQL: dict[str, str] = {
    "entry_offsets": _OFFSETS,
    "exact_once_coverage": """WITH l AS (SELECT l_orderkey, CAST(l_linenumber - 1 AS INT) AS revolution FROM lineitem),
        w AS (SELECT l_orderkey, CAST(unnest(range(0, max(revolution) + 1)) AS INT) AS revolution FROM l GROUP BY l_orderkey),
        t AS (SELECT l_orderkey, revolution, count(*) AS times FROM l GROUP BY ALL)
        SELECT l_orderkey, revolution, coalesce(times, 0) AS times FROM w FULL JOIN t USING (l_orderkey, revolution) WHERE coalesce(times, 0) <> 1""",
    "chunks_across_entries": """WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n,
            CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM conversations),
        e AS (SELECT conv_id, max("end") AS total FROM c GROUP BY conv_id)
        SELECT conv_id, turn, "end" - n AS start, "end" FROM c JOIN e USING (conv_id)
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(0, total, 512)) AS s) g WHERE c."end" - c.n >= s AND c."end" <= least(s + 512, total))""",
    "programme_regions": f"""WITH e AS ({_SAMPLES}),
        c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS cut,
              CAST(sum(samples) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM c)
        SELECT user_id, ordinal, any_value(event_type) AS event_type, min(stop - samples) AS start_sample, max(stop) AS end_sample,
               CAST(sum(samples) AS BIGINT) AS sample_count, count(*) AS n_rows FROM i GROUP BY user_id, ordinal""",
    "silence_spans": f"""WITH e AS ({_SAMPLES}),
        p AS (SELECT *, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after_entry FROM e)
        SELECT user_id, after_entry, CAST(sum(samples) AS BIGINT) AS amount, count(*) AS n_rows FROM p WHERE event_type <> 'click' GROUP BY user_id, after_entry""",
    "track_gap_interleave": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS n,
            lead(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL AS last FROM orders),
        p AS (SELECT o_custkey, o_orderkey, 0 AS side, 'track' AS kind, n AS count FROM o
              UNION ALL SELECT o_custkey, o_orderkey, 1, 'gap', CASE WHEN last THEN 0 ELSE o_orderkey % 3 END FROM o)
        SELECT o_custkey, CAST(row_number() OVER w AS INT) AS position, kind, CAST(sum(count) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - count AS first, count
        FROM p WHERE count > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey, side)""",
    "signature_sets": "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS one_value, count(l_suppkey) = count(DISTINCT l_suppkey) AS no_repeat FROM lineitem GROUP BY l_orderkey",
    "barcode_checks": """WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS body FROM part),
        s AS (SELECT p_partkey, body, list_sum(list_transform(range(1, 12), lambda i: CAST(body[i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS t FROM b),
        d AS (SELECT p_partkey, body, ((10 - t % 10) % 10 + CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 + 1 ELSE 0 END) % 10 AS digit, p_partkey % 7 = 0 AS short FROM s),
        v AS (SELECT *, NOT short AND p_partkey % 3 <> 0 AS valid FROM d)
        SELECT p_partkey, CASE WHEN short THEN body ELSE body || '-' || CAST(digit AS VARCHAR) END AS barcode, CASE WHEN valid THEN body || CAST(digit AS VARCHAR) END AS code, valid FROM v""",
    "segment_plan": "SELECT doc_id, CAST(start // 1000 AS INT) AS idx, start, least(1000, total - start) AS length FROM (SELECT doc_id, length(text) AS total, unnest(range(0, length(text), 1000)) AS start FROM documents)",
    "spec_checks": """WITH c AS (SELECT unnest([{'label': 'discount in range', 'ok': l_discount BETWEEN 0 AND 0.1}, {'label': 'quantity positive', 'ok': l_quantity > 0},
            {'label': 'returned lines filled', 'ok': l_returnflag <> 'R' OR l_linestatus = 'F'}, {'label': 'tax in range', 'ok': l_tax BETWEEN 0 AND 0.08}]) AS c FROM lineitem)
        SELECT c.label AS label, count(*) FILTER (WHERE c.ok) AS passed, count(*) FILTER (WHERE NOT c.ok OR c.ok IS NULL) AS failed FROM c GROUP BY ALL""",
    "radial_positions": f"""WITH o AS ({_OFFSETS}), f AS (SELECT *, CAST(byte_offset AS DOUBLE) / sum(byte_length) OVER (PARTITION BY l_orderkey) AS f FROM o)
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(least(greatest((281.0 - sqrt(greatest(281.0::DOUBLE * 281.0 - f * (281.0::DOUBLE * 281.0 - 115.0::DOUBLE * 115.0), 0.0))) / (281.0 - 115.0), 0.0), 1.0) * 1e6 + 0.5) AS BIGINT) AS radial_micros FROM f""",
    "track_labels": """SELECT conv_id, CAST(turn AS INT) AS turn, turn // 4 + 1 AS track FROM conversations""",
}
