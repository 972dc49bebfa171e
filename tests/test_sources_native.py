"""What Spark calls itself: table functions, the package source, VARIANT walks and state."""

import datetime
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from platterlake.functions import variants
from platterlake.functions.wire import write_varuint
from platterlake.sources import frames, package_source
from platterlake.streaming import receipts
from tests.test_sources import descriptor, package, stream


def test_frames(spark):
    whole = stream(lengths=(4, 5, 6))
    files = spark.createDataFrame([("a", whole), ("cut", whole[:-2]), ("not one", b"BRS2...."), ("none", None), ("empty", b"")], "path string, content binary")
    rows = frames.frames(files, payload=True).orderBy("path", "idx").collect()
    by = {p: [r for r in rows if r.path == p] for p in ("a", "cut", "not one", "none", "empty")}
    assert [(r.idx, bytes(r.payload), r.crc_ok, r.error) for r in by["a"]] == [(0, bytes(range(4)), True, None), (1, bytes(range(4, 9)), True, None), (2, bytes(range(9, 15)), True, None)]
    assert [r.idx for r in by["cut"]] == [0, 1, 2] and by["cut"][2].error and by["cut"][2].start is None
    assert all(len(by[p]) == 1 and by[p][0].error for p in ("not one", "none", "empty"))
    assert [tuple(r) for r in frames.places(frames.frames(files.where("path = 'a'"))).orderBy("idx").collect()] == [("a", 0, 0, 4), ("a", 1, 4, 9), ("a", 2, 9, 15)]
    with pytest.raises(Exception, match="binary"):
        spark.sql("SELECT * FROM stream_frames('text')").collect()


def test_a_million_frames_are_rows_not_an_array(spark):
    n = 1_000_000
    one = write_varuint(1) + struct.pack(">I", zlib.crc32(b"x")) + b"x"
    files = spark.createDataFrame([("a", b"BRS1" + struct.pack(">I", 2) + b"\x02\x00" + one * n)], "path string, content binary")
    r = frames.frames(files).agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.min("crc_ok").alias("ok"), F.count("error").alias("bad")).first()
    assert tuple(r) == (n, n - 1, True, 0)


def test_walk(spark):
    texts = {1: {"b": [1, "x"], "a": {"z": True, "y": "t"}, "n": None, "s": "q", "e": [], "o": {}, "d": 1.5}, 2: [1, "t", [None]], 3: 7, 6: {}, 7: "t", 8: None, 9: {"it's": {"a b": 2}}}
    rows = [*((k, json.dumps(v)) for k, v in texts.items()), (4, "{bad"), (5, None), (10, "")]
    found = variants.walk(spark.createDataFrame(rows, "root int, t string").withColumnRenamed("root", "id"), ["id"], "t").collect()
    got = sorted((r.id, r.root, r.pos, r.field, r.kind, r.first_kind, r.members) for r in found if r.id == 1)
    assert [g[3:] for g in got] == [("a", "object", "string", 2), ("b", "array", "number", 2), ("d", "number", None, None), ("e", "array", None, 0), ("n", "null", None, None), ("o", "object", None, 0), ("s", "string", None, None)]
    assert [(r.field, r.kind, r.first_kind, r.members) for r in found if r.id == 2] == [(None, "number", None, None), (None, "string", None, None), (None, "array", "null", 1)]
    assert sorted((r.id, r.root, r.kind) for r in found if r.id not in (1, 2, 9)) == [(3, "number", None), (4, None, None), (5, None, None), (6, "object", None), (7, "string", None), (8, "null", None), (10, None, None)]
    assert [(r.field, r.kind, r.first_kind) for r in found if r.id == 9] == [("it's", "object", "number")]


def packed(k, profile, payload=400):
    body = stream(lengths=(payload // 4,) * 2, tracks=(("One", 0, 2),), gaps=())
    extra = [(5, f"Title {k}".encode())]
    return package(descriptor(extra, stream_len=len(body), profile=profile), body)


@pytest.fixture
def folder(spark, tmp_path):
    made = [(f"p{k}", packed(k, k % 2)) for k in range(12)]
    bad = bytearray(made[0][1])
    bad[30] ^= 1
    rows = [*made, ("bad", bytes(bad)), ("empty", b""), ("cut", made[1][1][:-1])]
    where = str(tmp_path / "packages")
    package_source.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(3), where).count()
    package_source.register(spark)
    return where


def test_package_source_reads_what_is_asked_for(spark, folder):
    read = lambda schema: spark.read.format("packages").schema(schema).load(folder)
    names = read("path string, stream_length bigint, bytes_read bigint, error string").collect()
    assert len(names) == 15 and sum(r.error is not None for r in names) == 3
    assert all(r.bytes_read <= 180 for r in names if r.error is None)
    titles = read("title string, bytes_read bigint").where("title is not null").collect()
    assert len(titles) == 12 and all(180 < r.bytes_read < len(packed(1, 1)) for r in titles)
    whole = read("title string, stream binary, bytes_read bigint").where("title = 'Title 3'").first()
    assert bytes(whole.stream)[:4] == b"BRS1" and whole.bytes_read > titles[0].bytes_read


def test_package_source_filters_by_profile_before_it_reads_sections(spark, folder):
    found = spark.read.format("packages").load(folder).where("record_profile = 'lp' and size > 0").select("title", "stream")
    plan = found._jdf.queryExecution().toString()
    assert "= lp" not in plan.split("== Physical Plan ==")[1] and "= lp" in plan
    assert sorted(r.title for r in found.collect()) == sorted(f"Title {k}" for k in range(12) if k % 2 == 1)
    assert spark.read.format("packages").load(folder).where("record_profile = 'ten'").count() == 0


def test_package_source_plans_by_size(spark, folder):
    count = lambda columns, most: spark.read.format("packages").schema(columns).option("partition_bytes", most).load(folder).rdd.getNumPartitions()
    assert count("path string", 1 << 30) == 1 and count("path string", 1) == 15
    assert package_source._Reader(spark.read.format("packages").load(folder).schema, {"path": folder}).partitions()[0].files


def test_package_source_of_nothing(spark, tmp_path):
    package_source.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("packages").load(str(tmp_path / "none")).collect() == []


START = datetime.datetime(2024, 1, 1)
SCHEMA = "seq bigint, ts timestamp, d string, digest int"


def made(rng, a, b, late=0.0):
    return [(k, START + datetime.timedelta(seconds=60 * k - (rng.randint(200, 4000) if rng.random() < late else 0)), rng.choice(["hot", "hot", *"abcdefgh"]), 1) for k in range(a, b)]


def run(spark, base, rows=None, mode="append"):
    if rows is not None:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(f"{base}/in")
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = receipts.append(receipts.receipts(arriving, F.col("d"), "seq", "ts", 900, 7200), f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return query


def outcome(df):
    return sorted((r.digest, r.seq, r.ts, r.status) for r in df.collect())


def test_receipts_in_batches_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = made(rng, 0, 400, late=0.2)
    base = str(tmp_path)
    for a in (0, 90, 200):
        spark.createDataFrame(rows[a : {0: 90, 90: 200, 200: 260}[a]], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    first = run(spark, base)
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 3 and receipts.dropped(first) == 0
    run(spark, base, rows[260:330])
    run(spark, base, rows[330:])
    want = outcome(receipts.classified(spark.createDataFrame(rows, SCHEMA), F.col("d"), "seq", "ts", 900, 7200))
    assert outcome(spark.read.parquet(f"{base}/out")) == want
    assert {s for *_, s in want} == {"receipt", "repeat"}
    some = receipts.classified(spark.createDataFrame(rows, SCHEMA), F.col("d"), "seq", "ts", 900, 60)
    assert {s for *_, s in outcome(some)} == {"receipt", "repeat", "late"}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    rng = random.Random(4)
    rows = made(rng, 0, 300)
    old = [(1000 + k, START + datetime.timedelta(seconds=60 * k), "hot", 1) for k in range(50)]
    base = str(tmp_path)
    run(spark, base, rows)
    query = run(spark, base, old)
    assert receipts.dropped(query) == 50
    assert outcome(spark.read.parquet(f"{base}/out")) == outcome(receipts.classified(spark.createDataFrame(rows, SCHEMA), F.col("d"), "seq", "ts", 900, 7200))


def test_rows_without_digest_number_or_time(spark):
    rows = [(None, START, "a", 1), (1, None, "a", 1), (2, START, None, 1), (3, START, "a", None), (4, START, "a", 1)]
    assert [r[1::2] for r in outcome(receipts.classified(spark.createDataFrame(rows, SCHEMA), F.col("d"), "seq", "ts", 9, 9))] == [(3, "receipt"), (4, "repeat")]
    assert receipts.classified(spark.createDataFrame([], SCHEMA), F.col("d"), "seq", "ts", 9, 9).collect() == []


def test_many_digests_in_a_bucket_and_what_is_forgotten(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(k, START + datetime.timedelta(seconds=7 * k - rng.randint(0, 3000) * (rng.random() < 0.3)), f"d{rng.randint(0, 60)}", 1) for k in range(900)]
    monkeypatch.setattr(receipts, "BUCKETS", 3)
    for a in (0, 300, 600):
        run(spark, str(tmp_path), rows[a : a + 300])
    want = outcome(receipts.classified(spark.createDataFrame(rows, SCHEMA), F.col("d"), "seq", "ts", 900, 7200))
    assert outcome(spark.read.parquet(f"{tmp_path}/out")) == want and {s for *_, s in want} == {"receipt", "repeat"}
    # all but the last digests are forgotten once the watermark has passed their horizons
    last = [(1000, START + datetime.timedelta(days=2), "d0", 1)]
    query = run(spark, str(tmp_path), last)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3
    assert outcome(spark.read.parquet(f"{tmp_path}/out").where("seq = 1000"))[0][3] == "receipt"
    again = run(spark, str(tmp_path), [(1001 + k, START + datetime.timedelta(days=2, seconds=60 * k), f"d{k}", 1) for k in range(3)])
    assert receipts.dropped(again) == 0
    assert [r[1::2] for r in outcome(spark.read.parquet(f"{tmp_path}/out").where("seq > 1000"))] == [(1001, "repeat"), (1002, "receipt"), (1003, "receipt")]
