from pyspark.sql import functions as F

from platterlake.functions import timeline


def test_gap_arithmetic(spark):
    df = spark.createDataFrame([(1.0, "lp"), (0.00001, "ten"), (100.0, "single45"), (-1.0, "lp"), (2.0, "single45vintage")], "s double, p string")
    rows = df.select(timeline.gap_samples(df.s, F.lit(48_000)).alias("n"), timeline.gap_turns(df.s, df.p).alias("t"), timeline.gap_bytes(df.s, df.p, F.lit(1000.0)).alias("b")).collect()
    assert [r.n for r in rows] == [48_000, None, 4_800_000, None, 96_000]
    assert [None if r.t is None else round(r.t, 4) for r in rows] == [0.5556, 0.25, 8.0, None, None]
    assert [r.b for r in rows] == [1668, 750, 24_000, None, None]


def test_segment_budget(spark):
    df = spark.createDataFrame([("a", 0, 100, 0.5), ("a", 1, 64, 0.0), ("a", 2, 0, 1.0)], "path string, no int, n bigint, gap double")
    got = timeline.segment_budget(df, ["path"], ["no"], "n", "gap", 100, 64).orderBy("no").collect()
    assert [(r.track_segments, r.gap_samples, r.gap_segments, r.first_segment) for r in got] == [(2, 50, 1, 0), (1, 0, 0, 3), (1, 100, 2, 4)]
