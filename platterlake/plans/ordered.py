"""Registered queries over what has an order or a shape of its own: sweeps, replays, frames, package files, JSON members."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import variants
from ..operators import sweep
from ..sources import frames, package_source, streams
from ..streaming import receipts
from . import report, wire

DAY = 86_400_000_000
#: Seconds after which a digest is new again, and that a row may be behind.
HORIZON, DELAY = 6 * 3600, 3600


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_outside_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose days, from shipping on as many as their quantity, lie in no returned line's of the same supplier."""
    start = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"))
    returns = lines.where("l_returnflag = 'R'").select("l_suppkey", (F.col("start") - 1).alias("start"), "end")
    return sweep.contained(lines, returns, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "start", "end")


def purchase_after_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it, a day back at most."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("cents"))
    found = sweep.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), ["user_id"], "ts", ["event_id", "cents"], ties=["event_id"], name="view", inclusive=False, within=DAY)
    return found.select("event_id", "user_id", F.col("view.event_id").alias("view_id"), F.col("view.cents").alias("view_cents"))


def next_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the first error at or after it by time and number, whoever's: one key holds all rows."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.lit(1).alias("all"))
    found = sweep.as_of(events, events.where("event_type = 'error'"), ["all"], "ts", ["event_id"], name="error", forward=True, then=["event_id"])
    return found.select("event_id", F.col("error.event_id").alias("error_id"))


def _digest() -> Column:
    return F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")), 256)


def receipt_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts, repeats and late rows of all events, replayed as a stream in four steps into a table."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    folder = f"{sweep.shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    found = lambda arriving: receipts.receipts(arriving, _digest(), "event_id", "ts", HORIZON, DELAY, forget=False)
    receipts.replay(events, "event_id", f"{folder}/in", 4, lambda arriving: receipts.append(found(arriving), f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(receipts.SCHEMA).parquet(f"{folder}/out").select("digest", F.col("seq").alias("event_id"), "status")


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the orders' streams by the table function, and where each lies in its payload."""
    files = wire.order_streams(spark, sf_dir)
    whole = streams.records(files).where("error is null").select("path")
    found = sweep.settle(frames.frames(files.join(whole, "path", "left_semi")))
    placed = frames.places(found).withColumnRenamed("path", "of").withColumnRenamed("idx", "at")
    both = found.join(placed, (F.col("path") == F.col("of")) & (F.col("idx") == F.col("at")))
    return both.select(F.col("path").cast("bigint").alias("l_orderkey"), "idx", "start", "payload_start", "payload_end", "crc_ok", "first_byte", "last_byte")


def package_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the suppliers' packages of one profile, from files, with how many bytes were read for them."""
    folder = f"{sweep.shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    package_source.write_files(wire.supplier_packages(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    package_source.register(spark)
    found = spark.read.format("packages").schema("path string, record_profile string, title string, stream_length bigint, bytes_read bigint").load(folder).where("record_profile = 'lp'")
    return found.select(F.regexp_extract("path", r"(\d+)\.pkg$", 1).cast("bigint").alias("s_suppkey"), "title", "stream_length", "bytes_read")


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a JSON document for each order, some of them cut short, scalars or arrays."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id"), F.lit("c").alias("kind")).alias("customer"), F.lit(None).cast("string").alias("gone"), "lines", F.col("o_orderkey").alias("order"), (F.col("o_orderkey") % 2 == 0).alias("paid"), F.transform("lines", lambda x: x["n"] * 0.5).alias("shares"), F.col("o_orderstatus").alias("status")), {"ignoreNullFields": "false"})
    spoiled = F.col("o_orderkey") % 7
    text = F.when(spoiled == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(spoiled == 1, F.col("o_orderkey").cast("string")).when(spoiled == 2, F.to_json(F.transform("lines", lambda x: x["flag"]))).otherwise(whole)
    return variants.walk(orders.select("o_orderkey", text.alias("text")), ["o_orderkey"], "text")


def crowded_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each supplier with an entry and a track or gap for each of its lines.

    By four, 0 has gaps that all reach to the end, 1 a track for each entry, 2 the
    last entry left out, and 3 gaps of one entry between tracks of one.
    """
    made = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 65535")
    kind, n = F.col("s") % 4, F.col("n")
    track = lambda first, count: F.concat(c.wire_text(F.lit("T")), c.varuint(first), c.varuint(count))
    gap = lambda first, count, after: F.concat(c.varuint(first), c.varuint(count), c.varuint(after))
    each = lambda last, f: wire._joined(F.transform(F.sequence(F.lit(0).cast("bigint"), last), f))
    one = track(F.lit(0), F.when(kind == 0, F.lit(1)).otherwise(n - 1))
    tracks = F.when(kind.isin(0, 2), F.concat(wire._u(1, 2), one)).when(kind == 1, F.concat(wire._u(n, 2), each(n - 1, lambda i: track(i, F.lit(1)))))
    tracks = tracks.otherwise(F.concat(wire._u(F.ceil(n / 2), 2), each(F.ceil(n / 2) - 1, lambda i: track(2 * i, F.lit(1)))))
    half = F.floor(n / 2)
    gaps = F.when(kind == 0, F.concat(wire._u(n - 1, 2), each(n - 2, lambda i: gap(i + 1, n - 1 - i, F.lit(0))))).when(kind == 3, F.concat(wire._u(half, 2), each(half - 1, lambda i: gap(2 * i + 1, F.lit(1), i)))).otherwise(wire._u(0, 2))
    first = F.concat(F.unhex(F.lit("011F")), c.wire_text(F.lit("ECDC")), wire._u(48_000, 4), wire._u(2, 1), wire._u(20, 4), wire._u(5, 4), wire._u(10, 4), wire._u(2, 4), wire._bytes("{}"))
    meta = F.concat(F.unhex(F.lit("020C")), wire._u(1, 1), first, wire._u(n, 2), F.unhex(F.repeat(F.lit("01"), n.cast("int"))), tracks, gaps)
    content = F.concat(wire._bytes("BRS1"), wire._u(F.octet_length("meta"), 4), F.col("meta"), wire._chunk(F.encode(F.repeat(F.lit("x"), n.cast("int")), "UTF-8")))
    # few short rows become long streams, so their bytes say nothing of the work; by "s" the exchange would be left out
    spread = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = spread.withColumn("meta", meta).select(F.col("s").cast("string").alias("path"), content.alias("content"))
    found = sweep.settle(streams.records(files))
    regions = streams.regions(found).groupBy("path").agg(F.count(F.lit(1)).alias("regions"), F.max("end_sample").alias("samples")).withColumnRenamed("path", "of")
    both = found.join(regions, F.col("path") == F.col("of"), "left")
    return both.select(F.col("path").cast("bigint").alias("l_suppkey"), F.size("entries").cast("bigint").alias("n"), "error", "regions", "samples")


def silent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a stream for each customer of two tracks around an entry of silence.

    By nine, 1 has a silence without a rate in its descriptor, 2 one of no samples, 3
    one of another length than stated, 4 one with a byte that its seed does not give,
    5 an output range beyond its block, 6 no channels, 7 is encrypted, and 8 has the
    silence inside its first track.
    """
    k = F.col("c_custkey")
    spoiled = k % 9
    samples = 1000 + k % 7
    geometry = F.concat(wire._u(F.when(spoiled == 5, samples + 4).otherwise(samples + 9), 4), wire._u(5, 4), wire._u(samples, 4))
    first = F.concat(F.unhex(F.when(spoiled == 6, "011B").otherwise("011F")), c.wire_text(F.lit("ECDC")), wire._u(48_000, 4), F.when(spoiled == 6, F.unhex(F.lit(""))).otherwise(wire._u(2, 1)), geometry, wire._u(2, 4), wire._bytes("{}"))
    second = F.concat(F.unhex(F.lit("FF")), c.wire_text(F.lit("GAP")), F.unhex(F.when(spoiled == 1, "05").otherwise("07")), c.wire_text(F.lit("GAP")), F.when(spoiled == 1, F.unhex(F.lit(""))).otherwise(wire._u(48_000, 4)), wire._u(2, 1))
    filler = F.unhex(F.when(spoiled == 4, "FF").otherwise(""))
    stated = F.octet_length(filler) + streams.GAP_HEADER + (spoiled == 3).cast("int")
    silence = F.concat(F.lit(streams.GAP_MAGIC), F.unhex(F.lit("01000000")), wire._u(F.when(spoiled == 2, 0).otherwise(10 + k), 8), wire._u(stated, 8), wire._u(k, 4), filler)
    body = F.encode(F.repeat(F.lit("a"), (k % 40 + 1).cast("int")), "UTF-8")
    entry = lambda data, kind: F.concat(c.varuint(F.octet_length(data)), wire._u(kind, 1))
    track = lambda name, start, count: F.concat(c.wire_text(F.lit(name)), c.varuint(F.lit(start)), c.varuint(count))
    tracks = F.concat(track("One", 0, F.when(spoiled == 8, 2).otherwise(1)), track("Two", 2, F.lit(1)))
    meta = F.concat(F.unhex(F.when(spoiled == 7, "0207").otherwise("0206")), wire._u(2, 1), first, second, wire._u(3, 2), entry(body, 0), entry(silence, 1), entry(body, 0), wire._u(2, 2), tracks)
    payload = F.concat(body, silence, body)
    nonce = F.unhex(F.when(spoiled == 7, "00" * streams.NONCE_BYTES).otherwise(""))
    chunk = F.concat(c.varuint(F.octet_length(payload)), wire._u(F.crc32(payload), 4), nonce, payload)
    return _table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.concat(F.lit(streams.MAGIC), wire._u(F.octet_length(meta), 4), meta, chunk).alias("content"))


def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of the streams with silence, by record, descriptor and entry."""
    found = report.findings(streams.parsed(silent_files(spark, sf_dir)))
    return found.select(F.col("path").cast("bigint").alias("c_custkey"), "label", "idx", "ok", "detail")


def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the one JSON document of each order's stream says of it: lengths and digests."""
    files = wire.order_streams(spark, sf_dir)
    found = report.record_json(files, streams.parsed(files))
    at = lambda path, kind, name: F.get_json_object("json", f"$.{path}").cast(kind).alias(name)
    return found.select(F.col("path").cast("bigint").alias("l_orderkey"), at("record.error", "string", "error"), at("stream.n_chunks", "bigint", "n_chunks"), at("stream.payload_bytes", "bigint", "payload_bytes"), at("stream.payload_sha256", "string", "payload_sha256"), at("stream.chunks[0].sha256", "string", "first_sha256"), at("stream.tracks[0].title", "string", "title"))


def gap_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the streams with silence, and how long the sound ones last."""
    found = sweep.settle(streams.records(silent_files(spark, sf_dir)))
    silent = found.select(F.col("path").alias("of"), F.get("entries", F.lit(1))["samples"].alias("gap_samples"))
    return streams.summary(found).join(silent, F.col("path") == F.col("of")).select(F.col("path").cast("bigint").alias("c_custkey"), "error", "encrypted", "n_entries", F.when(F.col("error").isNull(), F.col("total_samples")).alias("total_samples"), F.when(F.col("error").isNull(), F.col("gap_samples")).alias("gap_samples"))


QUERIES = {f.__name__: f for f in (lines_outside_returns, purchase_after_view, next_error, receipt_replay, order_frames, package_titles, json_members, crowded_streams, gap_streams, record_findings, record_documents)}

_LINE = """SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS start,
    CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem"""
#: Members of an order's document: field, kind, kind of the first item, members.
_MEMBERS = "('customer', 'object', 'number', 2), ('gone', 'null', NULL, NULL), ('lines', 'array', 'object', k), ('order', 'number', NULL, NULL), ('paid', 'boolean', NULL, NULL), ('shares', 'array', 'number', k), ('status', 'string', NULL, NULL)"

ORACLE_SQL = {
    "lines_outside_returns": f"""WITH l AS ({_LINE}) SELECT l_suppkey, l_orderkey, l_linenumber, start, "end" FROM l
        WHERE NOT EXISTS (SELECT 1 FROM l r WHERE r.l_returnflag = 'R' AND r.l_suppkey = l.l_suppkey AND r.start - 1 <= l.start AND l."end" <= r."end")""",
    "purchase_after_view": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
        m AS (SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM p JOIN v ON p.user_id = v.user_id AND v.ts < p.ts AND p.ts - v.ts <= INTERVAL 1 DAY GROUP BY p.event_id)
        SELECT p.event_id, p.user_id, view_id, CAST(floor(v.value * 100) AS BIGINT) AS view_cents FROM p LEFT JOIN m USING (event_id) LEFT JOIN v ON v.event_id = view_id""",
    "next_error": """SELECT event_id, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS error_id FROM events""",
    "receipt_replay": f"""WITH e AS (SELECT sha256(user_id || ':' || event_type) AS digest, event_id, epoch_us(ts) AS t FROM events),
        n AS (SELECT *, max(t) OVER (PARTITION BY digest ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e)
        SELECT digest, event_id, CASE WHEN newest IS NULL OR t - newest > {HORIZON}000000 THEN 'receipt' WHEN t - newest < -{DELAY}000000 THEN 'late' ELSE 'repeat' END AS status FROM n""",
    "order_frames": f"""WITH f AS ({wire.ORACLE_SQL["stream_chunks"]}), s AS (SELECT *, CAST(sum(payload_end - payload_start) OVER (PARTITION BY l_orderkey ORDER BY idx) AS BIGINT) AS last_byte FROM f)
        SELECT l_orderkey, idx, start, payload_start, payload_end, crc_ok, last_byte - (payload_end - payload_start) AS first_byte, last_byte FROM s""",
    "package_titles": """SELECT s_suppkey, s_name AS title, 57 + strlen(s_name) + s_suppkey % 50 AS stream_length, 180 + 54 + strlen(s_name) AS bytes_read FROM supplier WHERE s_suppkey % 5 <> 2""",
    "json_members": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS s, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS k FROM orders)
        SELECT o_orderkey, 'object' AS root, pos, field, kind, first_kind, members FROM (
            SELECT o_orderkey, unnest(range(0, 7)) AS i, unnest([{_MEMBERS}]) AS m, m[1] AS field, m[2] AS kind, m[3] AS first_kind, CAST(m[4] AS INT) AS members, CAST(i AS INT) AS pos FROM o WHERE s > 2 AND k > 0)
        UNION ALL SELECT o_orderkey, CASE WHEN s = 1 THEN 'number' END, NULL, NULL, NULL, NULL, NULL FROM o WHERE s < 2 AND k > 0
        UNION ALL SELECT o_orderkey, 'array', CAST(unnest(range(0, k)) AS INT), NULL, 'string', NULL, NULL FROM o WHERE s = 2 AND k > 0""",
    "crowded_streams": """WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) BETWEEN 2 AND 65535)
        SELECT l_suppkey, n, CASE l_suppkey % 4 WHEN 0 THEN CASE WHEN n > 2 THEN 'a revolution is covered twice' END WHEN 2 THEN 'a revolution is not covered' END AS error,
            CASE WHEN l_suppkey % 4 IN (1, 3) THEN n WHEN l_suppkey % 4 = 0 AND n = 2 THEN 2 END AS regions, CASE WHEN l_suppkey % 4 IN (1, 3) OR l_suppkey % 4 = 0 AND n = 2 THEN 10 * n END AS samples FROM s""",
    "record_findings": """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS s, 1000 + c_custkey % 7 AS n, c_custkey % 40 + 1 AS b FROM customer),
        p AS (SELECT *, CASE WHEN s = 6 THEN 'channels are not stated' END AS mute, s = 7 AS shut, CASE WHEN s = 7 THEN 'entry is encrypted' END AS why FROM c WHERE s IN (0, 6, 7, 8)),
        f AS (SELECT k, unnest([
            {'label': 'stream parses', 'idx': NULL, 'bad': NULL, 'good': (116 - CASE WHEN s = 6 THEN 1 ELSE 0 END + CASE WHEN s = 7 THEN 12 ELSE 0 END + 2 * b) || ' bytes'},
            {'label': 'metadata version', 'idx': NULL, 'bad': NULL, 'good': 'version 2'},
            {'label': 'tracks and gaps', 'idx': NULL, 'bad': CASE WHEN s = 8 THEN 'a track or gap holds an auxiliary revolution' END, 'good': '2 tracks and 0 gaps hold every playable entry once'},
            {'label': 'bytes of the entries', 'idx': NULL, 'bad': NULL, 'good': '3 entries hold ' || (2 * b + 28) || ' bytes'},
            {'label': 'programme map', 'idx': NULL, 'bad': CASE WHEN shut THEN 'an entry has no known duration' WHEN s <> 8 THEN 'an entry is under no track or gap' END, 'good': (2 * n + 10 + k) || ' samples in 3 entries'},
            {'label': 'descriptor is valid', 'idx': 0, 'bad': NULL, 'good': 'container ECDC'}, {'label': 'descriptor is valid', 'idx': 1, 'bad': NULL, 'good': 'container GAP'},
            {'label': 'music is described', 'idx': 0, 'bad': mute, 'good': 'codec, format, output range and codec metadata are stated'},
            {'label': 'silence is described', 'idx': 1, 'bad': NULL, 'good': 'codec and format are stated, and nothing else'},
            {'label': 'music has a length', 'idx': 0, 'bad': why, 'good': n || ' samples, ' || b || ' bytes'}, {'label': 'music has a length', 'idx': 2, 'bad': why, 'good': n || ' samples, ' || b || ' bytes'},
            {'label': 'silence has a length', 'idx': 1, 'bad': why, 'good': (10 + k) || ' samples, 28 bytes'}]) AS f FROM p)
        SELECT k AS c_custkey, f.label AS label, CAST(f.idx AS INT) AS idx, f.bad IS NULL AS ok, coalesce(f.bad, f.good) AS detail FROM f
        UNION ALL SELECT k, 'stream parses', NULL, false, CASE s WHEN 1 THEN 'payload descriptor 1 is not a well-formed GAP descriptor' WHEN 5 THEN 'payload descriptor 0 has an output range outside its block' ELSE 'gap length, samples or filler disagree with its header' END FROM c WHERE s BETWEEN 1 AND 5""",
    "record_documents": f"""WITH {wire._STREAMS}, d AS (SELECT t.o, string_agg(repeat(chr(CAST(97 + l_linenumber % 26 AS INT)), len), '' ORDER BY idx) AS body, CAST(first(len ORDER BY idx) AS INT) AS head FROM t GROUP BY t.o),
        k AS (SELECT e.o, e.n, e.s, e.total, e.cut, body, head, CASE WHEN s = 3 AND total = 1 THEN 'chunk at byte ' || (SELECT h.head FROM h WHERE h.o = e.o) || ' is empty' WHEN s IN (0, 1, 2, 3, 6) THEN error END AS error FROM e JOIN d USING (o))
        SELECT o AS l_orderkey, error, CASE WHEN error IS NULL THEN CASE WHEN s <> 7 THEN n WHEN cut < total THEN 2 ELSE 1 END END AS n_chunks, CASE WHEN error IS NULL THEN total END AS payload_bytes,
            CASE WHEN error IS NULL THEN sha256(body) END AS payload_sha256, CASE WHEN error IS NULL THEN sha256(left(body, CASE WHEN s = 7 THEN CAST(least(cut, total) AS INT) ELSE head END)) END AS first_sha256,
            CASE WHEN error IS NULL THEN 'Side ' || o || '-1' END AS title FROM k""",
    "gap_streams": """WITH c AS (SELECT c_custkey, c_custkey % 9 AS s, c_custkey AS k FROM customer),
        e AS (SELECT *, CASE s WHEN 1 THEN 'payload descriptor 1 is not a well-formed GAP descriptor' WHEN 2 THEN 'gap length, samples or filler disagree with its header' WHEN 3 THEN 'gap length, samples or filler disagree with its header'
            WHEN 4 THEN 'gap length, samples or filler disagree with its header' WHEN 5 THEN 'payload descriptor 0 has an output range outside its block' WHEN 6 THEN 'a descriptor does not state codec, rate, channels and codec metadata'
            WHEN 8 THEN 'a track or gap holds an auxiliary revolution' END AS error FROM c)
        SELECT c_custkey, error, CASE WHEN s IN (0, 6, 7, 8) THEN s = 7 END AS encrypted, CASE WHEN s IN (0, 6, 7, 8) THEN 3 END AS n_entries,
            CASE WHEN s = 0 THEN 2 * (1000 + k % 7) + 10 + k END AS total_samples, CASE WHEN s = 0 THEN 10 + k END AS gap_samples FROM e""",
}
