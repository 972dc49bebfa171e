"""Relational shapes on small hand-made tables."""

from pyspark.sql import functions as F

from platterlake.functions import columns
from platterlake.operators import relational


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_offsets_and_containment(spark):
    e = spark.createDataFrame([("a", 0, 5), ("a", 1, 7), ("b", 0, 2)], "path string, idx int, n int")
    placed = relational.running_offsets(e, ["path"], ["idx"], "n", "start", "end").select("path", "idx", "start", "end")
    assert rows(placed, "path", "idx") == [("a", 0, 0, 5), ("a", 1, 5, 12), ("b", 0, 0, 2)]
    chunks = spark.createDataFrame([("a", 0, 0, 5), ("a", 1, 4, 6), ("b", 0, 1, 3), ("c", 0, 0, 1)], "path string, c int, start int, end int")
    assert [r[:2] for r in rows(relational.contained(chunks, placed, "path"), "path", "c")] == [("a", 1), ("b", 0), ("c", 0)]
    assert [r[:2] for r in rows(relational.contained(chunks, placed, "path", how="left_semi"), "path")] == [("a", 0)]


def test_coverage(spark):
    covered = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("b", 0)], "path string, rev int")
    last = spark.createDataFrame([("a", 4), ("b", 1), ("c", 0)], "path string, n int")
    assert rows(relational.coverage(covered, "path", "rev", last, "n"), "rev") == [("a", 1, 0), ("a", 2, 2), ("a", 3, 0)]


def test_regions_and_silences(spark):
    df = spark.createDataFrame([("p", i, k, 10) for i, k in enumerate(["x", "x", None, None, "x", "y"])], "path string, i int, label string, n int")
    got = rows(relational.merged_regions(df, ["path"], ["i"], "label", "n"), "ordinal")
    assert got == [("p", 1, "x", 0, 20, 20, 2), ("p", 2, None, 20, 40, 20, 2), ("p", 3, "x", 40, 50, 10, 1), ("p", 4, "y", 50, 60, 10, 1)]
    apart = relational.merged_regions(df, ["path"], ["i"], "label", "n", F.col("label").isNull())
    assert apart.count() == 5
    assert rows(relational.merged_silences(df, ["path"], ["i"], F.col("label").isNotNull(), "n"), "after_entry") == [("p", 2, 20, 2)]


def test_interleave_segments_checks(spark):
    t = spark.createDataFrame([("p", 1, 3), ("p", 2, 2)], "path string, no int, n int")
    assert rows(relational.interleaved(t, ["path"], ["no"], "n", F.lit(1)), "position") == [("p", 1, "track", 0, 3), ("p", 2, "gap", 3, 1), ("p", 3, "track", 4, 2)]
    assert rows(relational.segment_plan(t, ["no"], "n", 2), "no", "idx") == [(1, 0, 0, 2), (1, 1, 2, 1), (2, 0, 0, 2)]
    got = relational.checks(t, ["no"], {"big": F.col("n") > 2, "unknown": F.lit(None).cast("boolean")})
    assert rows(got, "no", "label") == [(1, "big", True), (1, "unknown", False), (2, "big", False), (2, "unknown", False)]


def test_scalars(spark):
    one = spark.createDataFrame([(bytearray(b"\x01\x02\xff\xff\xff\xff"), "us-rc1-76-07839", "036000291452", "01ARZ3NDEKTSV4RRFFQ69G5FAV", -1.5)], "b binary, i string, u string, t string, x double")
    c = F.col
    got = one.select(columns.u16be(c("b"), 0), columns.u32be(c("b"), 2), columns.u32be(c("b"), 3), columns.isrc(c("i")), columns.upc(c("u")), columns.ulid_millis(c("t")), columns.round_half_up(c("x"))).first()
    assert tuple(got) == (258, 4294967295, None, "USRC17607839", "036000291452", 1469922850259, -1)
    bad = spark.createDataFrame([("US12", "036000291453", "8ZZZZZZZZZZZZZZZZZZZZZZZZZ")], "i string, u string, t string")
    assert tuple(bad.select(columns.isrc(c("i")), columns.upc(c("u")), columns.ulid_millis(c("t"))).first()) == (None, None, None)
    assert spark.sql("select crc32('123456789')").first()[0] == 3421780262
