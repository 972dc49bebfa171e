"""Joins by order against all pairs, at shapes that are hostile to a sweep."""

import datetime
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from platterlake.functions.wire import write_varuint
from platterlake.operators import relational, sweep
from platterlake.sources import streams
from tests.test_sources import text


@pytest.mark.parametrize("seed", range(3))
def test_contained_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(rng.choice(["hot", "hot", "a", None]), i, a, None if rng.random() < 0.05 else a + rng.randint(0, 12)) for i in range(n) for a in [rng.choice([rng.randint(0, 60), 7, 10**15])]]
    parts, wholes = draw(300), draw(60)
    schema = "key string, value int, start bigint, end bigint"
    p, w = spark.createDataFrame(parts + parts[:5], schema).repartition(5), spark.createDataFrame(wholes, schema)
    inside = lambda x: x[0] is not None and x[3] is not None and any(y[0] == x[0] and y[3] is not None and y[2] <= x[2] and x[3] <= y[3] for y in wholes)
    for how, want in (("left_semi", True), ("left_anti", False)):
        got = [tuple(r) for r in relational.contained(p, w, "key", how=how).collect()]
        assert sorted(got, key=repr) == sorted((x for x in parts + parts[:5] if inside(x) == want), key=repr)


def test_one_key_with_sixty_thousand_intervals(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("start"), (F.lit(2 * n) - F.col("id")).alias("end"), "id")
    began = time.time()
    assert relational.contained(rows, rows, "key", how="left_semi").count() == n
    assert relational.contained(rows.withColumn("end", F.lit(3 * n)), rows, "key").count() == n
    assert time.time() - began < 30


def test_a_key_is_cut_into_ranges(spark):
    line = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 3, F.col("id")).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.at: r.best for r in sweep.carried(line, line, ["k"], "at", F.col("v"), "best").collect()}
        before = {r.at: r.best for r in sweep.carried(line, line, ["k"], "at", F.col("v"), "best", inclusive=False).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == {i: None if i < 3 else (i - 3) // 1000 * 1000 + 3 for i in range(5000)}
    assert before == {i: None if i < 4 else (i - 4) // 1000 * 1000 + 3 for i in range(5000)}


@pytest.mark.parametrize(("forward", "inclusive", "within"), [(False, True, None), (False, False, None), (True, True, None), (True, False, 5_000_000), (False, True, 3_000_000)])
def test_as_of_equals_all_pairs(spark, forward, inclusive, within):
    rng = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    draw = lambda n, m: [(rng.choice(["u", "u", "v", None]), i, None if rng.random() < 0.05 else start + datetime.timedelta(seconds=rng.randint(0, m))) for i in range(n)]
    asked, given = draw(200, 60), draw(80, 60)
    schema = "found_key string, row int, at timestamp"
    a, g = spark.createDataFrame(asked, schema), spark.createDataFrame(given, schema)

    def best(x):
        if x[0] is None or x[2] is None:
            return None
        sign = -1 if forward else 1
        near = [(sign * (y[2] - x[2]).total_seconds(), y[1]) for y in given if y[0] == x[0] and y[2] is not None]
        near = [y for y in near if y[0] < 0 or (inclusive and y[0] == 0)]
        top = max(near, default=None)
        return None if top is None or (within is not None and -top[0] * 1e6 > within) else top[1]

    got = sweep.as_of(a, g, ["found_key"], "at", ["row"], name="near", inclusive=inclusive, forward=forward, within=within).collect()
    assert sorted((r.row, r.near and r.near.row) for r in got) == sorted((x[1], best(x)) for x in asked)


@pytest.mark.parametrize(("forward", "inclusive", "within"), [(False, True, None), (True, True, None), (True, False, None), (True, True, 1), (False, False, 0)])
def test_as_of_by_what_orders_one_place(spark, forward, inclusive, within):
    rng = random.Random(11)
    rows = [(rng.choice("uv"), None if rng.random() < 0.05 else rng.randint(0, 4), None if rng.random() < 0.05 else i, rng.random() < 0.3) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, at bigint, id bigint, good boolean")

    def best(x):
        sign = -1 if forward else 1
        near = [(sign * y[1], sign * y[2]) for y in rows if y[3] and y[0] == x[0] and None not in y[1:3]]
        here = None if None in x[1:3] else (sign * x[1], sign * x[2])
        top = max((y for y in near if here and (y < here or (inclusive and y == here))), default=None)
        return None if top is None or (within is not None and here[0] - top[0] > within) else sign * top[1]

    got = sweep.as_of(df, df.where("good"), ["k"], "at", ["id"], forward=forward, inclusive=inclusive, within=within, then=["id"]).collect()
    assert sorted(((r.k, r["at"], r.id, r.found and r.found.id) for r in got), key=repr) == sorted(((*x[:3], best(x)) for x in rows), key=repr)


def test_hot_place_and_empty_tables(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), F.lit(5).cast("bigint").alias("at"), "id")
    got = sweep.as_of(rows, rows, ["k"], "at", ["id"]).select("found.id").distinct().collect()
    assert [r.id for r in got] == [2999]
    none = rows.where("false")
    assert sweep.as_of(none, rows, ["k"], "at", ["id"]).collect() == [] and sweep.as_of(rows, none, ["k"], "at", ["id"]).where("found is not null").count() == 0
    assert relational.contained(rows.withColumn("end", F.lit(6)), none.withColumn("end", F.lit(9)), "k", "at", "end").count() == 3000


def test_streams_with_as_many_ranges_as_the_format_allows(spark):
    n = 65_535
    nested = tuple((i, n - i, 0) for i in range(n))
    rows = [("overlapping", hostile_bytes(n, [("T", 0, 1)], nested)), ("single tracks", hostile_bytes(n, [("T", i, 1) for i in range(n)], ())), ("tracks and gaps", hostile_bytes(n, [("T", 2 * i, 1) for i in range(n // 2 + 1)], [(2 * i + 1, 1, i) for i in range(n // 2)])), ("one short", hostile_bytes(n, [("T", 0, n - 1)], ()))]
    began = time.time()
    files = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    found = streams.records(files)
    got = {r.path: r.error for r in found.select("path", "error").collect()}
    assert got == {"overlapping": "a revolution is covered twice", "single tracks": None, "tracks and gaps": None, "one short": "a revolution is not covered"}
    assert {r.path: r["count"] for r in streams.regions(found).groupBy("path").count().collect()} == {"single tracks": n, "tracks and gaps": n}
    assert time.time() - began < 120


def hostile_bytes(n, tracks, gaps):
    meta = bytes([2, 4 | (8 if gaps else 0), 1, 1, 31]) + text("ECDC") + struct.pack(">IBIIII", 48_000, 2, 1000, 5, 900, 2) + b"{}"
    meta += struct.pack(">H", n) + b"\x01" * n
    meta += struct.pack(">H", len(tracks)) + b"".join(text(t) + write_varuint(a) + write_varuint(m) for t, a, m in tracks)
    if gaps:
        meta += struct.pack(">H", len(gaps)) + b"".join(b"".join(map(write_varuint, g)) for g in gaps)
    payload = b"x" * n
    return b"BRS1" + struct.pack(">I", len(meta)) + meta + write_varuint(n) + struct.pack(">I", zlib.crc32(payload)) + payload
