"""Registered queries on the smallest tables against their SQL."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from platterlake.functions import columns, identifiers
from platterlake.plans import ordered, queries, summaries, wire

FOLDER = "/root/testdata/sf0.001"
ALL, SQL = queries.QUERIES | wire.QUERIES | ordered.QUERIES | summaries.QUERIES, queries.ORACLE_SQL | wire.ORACLE_SQL | ordered.ORACLE_SQL | summaries.ORACLE_SQL


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, tables, name):
    df = ALL[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr) and got


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_associated_data_of_every_stream(spark, tables):
    """Every order's stream, with its metadata as it stands in the bytes."""
    rows = {r.l_orderkey: r for r in wire.chunk_aads(spark, FOLDER).collect()}
    made = {int(r.path): bytes(r.content) for r in wire.order_streams(spark, FOLDER).collect()}
    assert len(rows) == tables.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0] and rows.keys() == made.keys()
    for o, content in made.items():
        size = int.from_bytes(content[4:8], "big")
        aad = b"aad-1" + content[4 : 8 + size]
        assert (rows[o].n, rows[o].aad_bytes, rows[o].aad_sha256) == (size, len(aad), hashlib.sha256(aad).hexdigest())


def against_sql(spark, folder, name, **made):
    """A query over made tables against its SQL over the same."""
    con = duckdb.connect()
    for table, df in made.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = ALL[name](spark, str(folder))
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert rows and rows == sorted(found.fetchall(), key=repr)


def test_next_error_among_events_of_one_time(spark, tmp_path):
    events = spark.range(200).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 37 % 5) AS ts", "id % 7 AS user_id", "CASE WHEN id % 6 = 1 THEN 'error' ELSE 'view' END AS event_type", "1.0D AS value")
    against_sql(spark, tmp_path, "next_error", events=events)


def test_receipts_of_events_whose_times_begin_again(spark, tmp_path):
    """No row is lost, however far it is behind what came in the steps before."""
    events = spark.range(600).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id % 100 * 1700 + id * 37 % 11) AS ts", "id * 13 % 17 AS user_id", "CASE WHEN id % 6 = 1 THEN 'error' ELSE 'view' END AS event_type", "1.0D AS value")
    against_sql(spark, tmp_path, "receipt_replay", events=events)


def test_numbers_beyond_63_bits_are_rows_without_a_number(spark, tmp_path):
    """The SQL ends in an error where a product is beyond 63 bits; it is asked for the others."""
    keys = [(o, k) for o in (0, 1, 2, 2**21, 2**31 - 1, 2**31, 3 * 10**9, 2**40) for k in (0, 1, 2, 3, 2**40)]
    keys = [(o + i, k) for i, (o, k) in enumerate(keys)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r for r in wire.varuint_scan(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT)")
    con.executemany("INSERT INTO orders VALUES (?, ?)", [(o, k) for o, k in keys if o * o * k < 2**63])
    want = {r[0]: r for r in con.execute(SQL["varuint_scan"]).fetchall()}
    assert got.keys() == {o for o, _ in keys} and 0 < len(want) < len(keys)
    for o, r in got.items():
        assert tuple(r) == want.get(o, (o, None, None, None))


@pytest.mark.parametrize("millis", [2**48 - 1, 2**48, 2**48 + 7, 3_257_812 * 86_400_007])
def test_times_of_identifiers_have_48_bits(spark, millis):
    """As the format has it: what is beyond 48 bits of a time is not in the identifier."""
    text = spark.range(1).select(columns.typed_id("trk", F.lit(millis), F.unhex(F.lit("ab" * 10))).alias("id"))
    got = text.select("id", columns.ulid_millis(F.substring("id", 5, 26)).alias("millis"), identifiers.kind(F.col("id")).alias("kind")).first()
    assert identifiers.to_bytes(got.id) == (millis % 2**48).to_bytes(6, "big") + b"\xab" * 10
    assert (got.millis, got.kind) == (millis % 2**48, "track")
